"""Node files: Markdown with YAML front matter, one node a file; the file's stem is its id."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.folders import written
from loomwright.functions.workers import bounded_batches
from loomwright.schemas import LEVELS, NODE, NODE_TYPES, STATUSES, TRANSPARENCIES
from loomwright.sources.named_files import read_files, write_files

try:
    import yaml
except ImportError:  # reading and writing node files needs it, nothing else does
    yaml = None
#: The parser in C where PyYAML has it: the same values, several times as fast.
LOADER = getattr(yaml, "CSafeLoader", getattr(yaml, "SafeLoader", None))
DUMPER = getattr(yaml, "CSafeDumper", getattr(yaml, "SafeDumper", None))

# The order of keys in a file, and which must be there.
KEYS = "id title_de title_en type cefr cefr_basis register themes separable family_transparency root lemmas examples links source_ids confidence status version updated_at".split()
REQUIRED = ("id", "title_de", "title_en", "type", "cefr", "status", "source_ids")
ENUMS = {"type": NODE_TYPES, "cefr": LEVELS, "status": STATUSES, "family_transparency": TRANSPARENCIES}


def parse_node(name: str, text: str) -> dict:
    """A node as a dict; raises ``ValueError`` on anything that is not one."""
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read node files")
    head, mark, body = text.removeprefix("﻿").partition("---\n")[2].partition("\n---")
    if not text.startswith("---") or not mark:
        raise ValueError(f"{name}: no front matter")
    meta = yaml.load(head, LOADER) or {}
    unknown = set(meta) - set(KEYS)
    missing = [k for k in REQUIRED if meta.get(k) is None]
    if unknown or missing:
        raise ValueError(f"{name}: unknown {sorted(unknown)}, missing {missing}")
    for key, allowed in ENUMS.items():
        if meta.get(key) is not None and meta[key] not in allowed:
            raise ValueError(f"{name}: {key} is {meta[key]!r}")
    if meta["id"] != name:
        raise ValueError(f"{name}: the id is {meta['id']!r}")
    stamp = meta.get("updated_at")
    if isinstance(stamp, date) and not isinstance(stamp, datetime):
        meta["updated_at"] = datetime(stamp.year, stamp.month, stamp.day)
    return {k: meta.get(k) for k in KEYS} | {"body_md": body.lstrip("-").strip("\n")}


def dump_node(node: dict) -> str:
    """File text of a node: keys in order, absent ones left out, empty lists kept."""
    if yaml is None:
        raise RuntimeError("PyYAML is needed to write node files")
    meta = {k: node[k] for k in KEYS if node.get(k) is not None}
    options = {"sort_keys": False, "allow_unicode": True, "default_flow_style": False, "width": 1000}
    head = yaml.dump(meta, Dumper=DUMPER, **options)
    if "\\" in head:
        # the writer in C escapes more than the other
        head = yaml.safe_dump(meta, **options)
    return f"---\n{head}---\n\n{(node.get('body_md') or '').rstrip()}\n"


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.md`` of a folder as nodes, by id; a bad file fails the read with its name."""
    bounded_batches(spark)
    files = read_files(spark, folder, ".md")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                from urllib.parse import unquote

                node = parse_node(unquote(path.rsplit("/", 1)[-1]).removesuffix(".md"), content.decode("utf-8"))
                node["updated_at"] = node["updated_at"].isoformat() if node["updated_at"] else None
                rows.append(json.dumps(node, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["node"])

    # a sort reads its input twice: files are read and parsed once before it
    parsed = written(files.mapInArrow(run, "node string"), "parsed")
    return parsed.select(F.from_json("node", NODE, {"mode": "FAILFAST"}).alias("n")).select("n.*").orderBy("id")


def node_texts(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, text``: the file text of each node; string columns ``keep``, which are no part of it, stay beside."""
    bounded_batches(nodes.sparkSession)
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [dump_node(json.loads(x)) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    node = F.to_json(F.struct(*(c for c in nodes.columns if c not in keep)))
    return nodes.select(*(F.col(c).cast("string") for c in names), node.alias("node")).mapInArrow(run, ", ".join(f"`{c}` string" for c in [*names, "text"]))


def write_nodes(nodes: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One ``<id>.md`` a node, written by tasks and moved into place when all have succeeded."""
    write_files(node_texts(nodes).select(F.concat("id", F.lit(".md")).alias("name"), "text"), folder, overwrite)


def write_queue(staged: DataFrame, folder: str) -> None:
    """Staged candidates ``(source_id, node columns)`` as ``<source_id>/<id>.md``."""
    texts = node_texts(staged.where("id is not null"), ("source_id",))
    write_files(texts.select(F.concat_ws("/", "source_id", F.concat("id", F.lit(".md"))).alias("name"), "text"), folder)
