"""Row types of the corpus, as DDL strings; readers use them and never infer."""

# Field names and types of the stored records.
LINK = "struct<target:string, relation:string, confidence:double>"
EXAMPLE = "struct<de:string, en:string, source_id:string, register:array<string>>"
NODE = f"""id string, title_de string, title_en string, type string, cefr string, cefr_basis string,
  register array<string>, themes array<string>, separable boolean, family_transparency string, root string,
  lemmas array<string>, examples array<{EXAMPLE}>, links array<{LINK}>, source_ids array<string>,
  confidence double, status string, version int, updated_at timestamp, body_md string"""
MATCH = "left_id string, right_id string, tier string, similarity double, band string"
SIDECAR = """source_id string, original_path string, content_sha256 string, ingested_at timestamp, chars long,
  model string, provider string, candidate_count int, artifact_suffix string, ocr_model string, ocr_provider string,
  ocr_sha256 string, ocr_edited boolean, source_document string, page int"""
CANDIDATE = """title_de string, title_en string, type string, cefr string, cefr_basis string,
  register array<string>, themes array<string>, body_md string, confidence double"""
DECISION = """decision_id string, proposal_id string, decided_at timestamp, approved boolean, kind string,
  outcome string, winner string, loser string, source_id string, similarity double, tier string,
  confidence double, relation string, direction string, basis string, provider string, model string,
  changelog string, flags array<string>"""
USAGE = """ts string, step string, provider string, model string, cache_key string, cached boolean,
  prompt_tokens long, cached_prompt_tokens long, completion_tokens long, total_tokens long, priced boolean,
  cost_usd double, saved_usd double, latency_ms long, finish_reason string, error string"""
PROPOSAL = """id string, kind string, outcome string, basis string, source_id string, candidate string,
  counterpart string, winner string, loser string, relation string, direction string, cefr string,
  cefr_basis string, root string, lemmas array<string>, separable boolean, family_transparency string,
  similarity double, tier string, band string, confidence double, reason string, b_adds string,
  changelog string, flags array<string>, candidate_path string, provider string, model string,
  created_at string, body_md string"""
NODE_TYPES = ("grammar", "vocab", "phrase", "pattern", "culture")
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
STATUSES = ("draft", "reviewed", "stable")
TRANSPARENCIES = ("high", "drifted", "opaque")
