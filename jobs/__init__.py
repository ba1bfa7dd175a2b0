"""Jobs that run the library over tables: each has a command line and a config file beside it."""
