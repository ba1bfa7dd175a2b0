"""Reviews against a plain fold over proposals in order, and proposals that are complete."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from loomwright.operators import ledger, merge, review
from loomwright.schemas import DECISION, NODE, PROPOSAL

NOW = datetime(2026, 1, 2, 3, 4, 5)
RANK = {"create": 0, "merge": 1, "link": 2, "relevel": 3, "morphology": 4, "discard": 5}
NODE_NAMES = [f.strip().split(" ", 1)[0] for f in "id, title_de, title_en, type, cefr, cefr_basis, register, themes, separable, family_transparency, root, lemmas, examples, links, source_ids, confidence, status, version, updated_at, body_md".split(",")]
FIELDS = [f.strip().split(" ", 1)[0] for f in " ".join(PROPOSAL.split()).split(", ")]


def node(i, **more):
    return {n: None for n in NODE_NAMES} | {"id": i, "title_de": i, "title_en": i, "type": "vocab", "cefr": "A1", "status": "stable", "source_ids": [f"s-{i}"], "body_md": f"body {i}", "version": 1} | more


def frame(spark, rows, schema=NODE, names=NODE_NAMES):
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def proposal(i, kind, **more):
    return {n: None for n in FIELDS} | {"id": i, "kind": kind, "similarity": 0.5} | more


def plain(nodes, staged, pending, decisions):
    """One proposal after the other."""
    nodes, staged = {n["id"]: dict(n) for n in nodes}, {n["id"]: dict(n) for n in staged}
    states, archived = {}, []
    order = sorted((p for p in pending if p["id"] in decisions), key=lambda p: (RANK[p["kind"]], -(p["similarity"] or 0), p["id"]))
    for p in order:
        if not decisions[p["id"]]:
            states[p["id"]] = "rejected"
            continue
        state, kind = "refused", p["kind"]
        if kind == "create":
            if p["candidate"] in nodes:
                state = "recorded"
            elif p["candidate"] in staged:
                nodes[p["candidate"]], state = staged.pop(p["candidate"]), "applied"
        elif kind == "merge":
            w, lo = p["winner"], p["loser"]
            if w != lo and w in nodes and (lo in nodes or lo in staged):
                lost = nodes.pop(lo) if lo in nodes else staged[lo]
                staged.pop(lo, None)
                n = nodes[w]
                n["source_ids"] = list(dict.fromkeys([*n["source_ids"], *lost["source_ids"]]))
                n["body_md"], n["version"] = p["body_md"], (n["version"] or 1) + 1
                if p["outcome"] == "OVERLAP" and n["status"] == "stable":
                    n["status"] = "reviewed"
                archived.append((lo, w))
                state = "applied"
        elif kind == "link":
            a, b = (p["counterpart"], p["candidate"]) if p["direction"] == "a_to_b" else (p["candidate"], p["counterpart"])
            if a in nodes and b in nodes and p["relation"]:
                links = nodes[a]["links"] or []
                if any(x["target"] == b and x["relation"] == p["relation"] for x in links):
                    state = "unchanged"
                else:
                    nodes[a]["links"], state = [*links, {"target": b, "relation": p["relation"], "confidence": p["confidence"]}], "applied"
        elif kind in ("relevel", "morphology"):
            names = ["cefr", "cefr_basis"] if kind == "relevel" else ["root", "lemmas", "separable", "family_transparency"]
            said = {k: p[k] for k in names if p[k] is not None}
            if p["candidate"] in nodes and (said.get("cefr") if kind == "relevel" else said):
                nodes[p["candidate"]] |= said
                nodes[p["candidate"]]["version"] = (nodes[p["candidate"]]["version"] or 1) + 1
                state = "applied"
        else:
            state = "applied"
        states[p["id"]] = state
    return nodes, staged, states, archived


def shown(rows):
    keep = [n for n in NODE_NAMES if n != "updated_at"]
    out = {}
    for r in rows:
        r = r if isinstance(r, dict) else r.asDict(recursive=True)
        out[r["id"]] = {k: [tuple(x.items()) for x in r[k] or []] if k == "links" else r[k] for k in keep}
    return out


def random_case(seed):
    rng = random.Random(seed)
    ids = [f"n{k:02d}" for k in range(14)]
    nodes = [node(i, version=rng.choice([None, 1, 3]), links=[{"target": rng.choice(ids), "relation": "r", "confidence": None}] if rng.random() < 0.3 else None) for i in ids[:8]]
    staged = [node(i, status="draft") for i in ids[7:12]]
    pending = []
    for k in range(30):
        kind = rng.choice(["create", "merge", "merge", "merge", "link", "link", "relevel", "relevel", "morphology", "discard"])
        p = proposal(f"{kind}-{k:02d}", kind, similarity=rng.choice([None, 0.2, 0.9]), candidate=rng.choice(ids), counterpart=rng.choice(ids), confidence=0.5)
        if kind == "merge":
            p |= {"winner": rng.choice(ids), "loser": rng.choice(ids), "outcome": rng.choice(["SAME", "OVERLAP"]), "body_md": f"merged {k}"}
        if kind == "link":
            p |= {"relation": rng.choice(["r", "q", None]), "direction": rng.choice(["a_to_b", "b_to_a"])}
        if kind == "relevel":
            p |= {"cefr": rng.choice(["B1", "C1", None]), "cefr_basis": rng.choice(["x", None])}
        if kind == "morphology":
            p |= {"root": rng.choice([None, "w"]), "lemmas": rng.choice([None, ["l"]]), "separable": rng.choice([None, True])}
        pending.append(p)
    decisions = {p["id"]: rng.random() < 0.85 for p in pending if rng.random() < 0.9}
    return nodes, staged, pending, decisions


def run(spark, nodes, staged, pending, decisions, past=None, archived=None):
    said = spark.createDataFrame([(i, ok, NOW, None) for i, ok in decisions.items()], "proposal_id string, approved boolean, decided_at timestamp, note string")
    none = spark.createDataFrame([], "node_id string")
    return review.review(nodes, staged, pending, said, past, archived or none, F.lit(NOW))


def test_reviews_equal_a_fold(spark):
    for seed in range(4):
        nodes, staged, pending, decisions = random_case(seed)
        got = run(spark, frame(spark, nodes), frame(spark, staged), frame(spark, pending, PROPOSAL, FIELDS), decisions)
        want_nodes, want_staged, states, archived = plain(nodes, staged, pending, decisions)
        assert {r.proposal_id: r.state for r in got.results.collect()} == states
        assert shown(got.nodes.collect()) == shown(want_nodes.values())
        assert shown(got.staged.collect()) == shown(want_staged.values())
        assert sorted((r.node_id, r.merged_into) for r in got.archived.collect()) == sorted(archived)
        assert {r.proposal_id for r in got.ledger.collect()} == {i for i, s in states.items() if s != "refused"}
        assert {r.id for r in got.pending.collect()} == {p["id"] for p in pending if states.get(p["id"], "open") in ("open", "refused", "recorded")}


def test_a_replay_changes_nothing(spark):
    nodes, staged, pending, decisions = random_case(9)
    first = run(spark, frame(spark, nodes), frame(spark, staged), frame(spark, pending, PROPOSAL, FIELDS), decisions)
    done = {r.proposal_id for r in first.ledger.select("proposal_id").collect()}
    # the same decisions again, over proposals that were not removed
    again = run(spark, first.nodes, first.staged, frame(spark, pending, PROPOSAL, FIELDS), {i: ok for i, ok in decisions.items() if i in done}, first.ledger, first.archived)
    assert shown(again.nodes.collect()) == shown(first.nodes.collect()) and again.ledger.isEmpty() and again.archived.isEmpty() and again.results.isEmpty()


def test_creates_come_before_links(spark):
    nodes, staged = [node("a")], [node("b", status="draft")]
    pending = [proposal("link-1", "link", candidate="b", counterpart="a", relation="r", direction="a_to_b", similarity=0.99), proposal("create-1", "create", candidate="b", similarity=0.1)]
    got = run(spark, frame(spark, nodes), frame(spark, staged), frame(spark, pending, PROPOSAL, FIELDS), {"link-1": True, "create-1": True})
    assert {r.state for r in got.results.collect()} == {"applied"}
    assert [(x.target, x.relation) for x in got.nodes.where("id = 'a'").first().links] == [("b", "r")]
    # nothing to review
    none = run(spark, frame(spark, nodes), frame(spark, staged), frame(spark, pending, PROPOSAL, FIELDS).limit(0), {})
    assert none.nodes.count() == 1 and none.ledger.isEmpty()


def test_rejected_merges_are_not_proposed_again(spark):
    judged = spark.createDataFrame(
        [("c1", "n1", 1, "SAME", "threshold", 0.96, 0.96, "semantic", "duplicate", None, None, None, None, None, None), ("c2", "n1", 1, "OVERLAP", "llm", 0.5, 0.9, "semantic", "gray", None, None, "why", "adds", "p", "m"),
         ("c3", "n2", 1, "OVERLAP", "llm", 0.9, 0.9, "semantic", "gray", None, None, None, None, "p", "m"), ("c4", "n2", 1, "DISTINCT_RELATED", "llm", 0.9, 0.88, "semantic", "gray", "contrasts", "b_to_a", "as said", None, "p", "m"), ("c5", "n2", 1, "OVERLAP", "llm", 0.9, 0.9, "semantic", "gray", None, None, None, None, "p", "m")],
        "candidate string, other string, rank int, outcome string, basis string, confidence double, similarity double, tier string, band string, relation string, direction string, reason string, b_adds string, provider string, model string",
    )
    candidates = spark.createDataFrame([(f"c{k}", f"src{k}", "queue/x" if k != 1 else None, ["s1", "s2"], f"## Examples\n- new {k}") for k in range(1, 6)], "id string, source_id string, path string, source_ids array<string>, body_md string")
    nodes = spark.createDataFrame([("n1", ["s1"], "## Examples\n- old"), ("n2", ["s1"], "two")], "id string, source_ids array<string>, body_md string")
    caps = spark.createDataFrame([("n1", True, 0), ("n2", False, 5)], "id string, allowed boolean, n_merges long")
    new = spark.createDataFrame([("c2", "n1", "fresh body", "log", True)], "candidate string, other string, body_md string, changelog string, unsourced boolean")
    out = review.complete(judged, candidates, nodes, caps, new, F.lit(NOW))
    assert out.columns == FIELDS
    got = {r.candidate + r.kind: r for r in out.collect()}
    # a candidate that is a node and has more sources wins; a staged one loses
    assert (got["c1merge"].winner, got["c1merge"].loser) == ("c1", "n1") and got["c1merge"].body_md == "## Examples\n- new 1\n- old\n"
    assert (got["c2merge"].winner, got["c2merge"].loser, got["c2merge"].body_md, got["c2merge"].flags) == ("n1", "c2", "fresh body", ["unsourced-examples", "low-confidence"])
    assert (got["c3discard"].outcome, got["c3discard"].flags, got["c3discard"].winner) == ("MANUAL", ["cap-reached"], "n2") and "5" in got["c3discard"].body_md
    assert got["c4create"].body_md == "" and got["c4link"].relation == "contrasts" and got["c4link"].body_md.startswith("Edge: c4 -contrasts-> n2")
    assert set(got) == {"c1merge", "c2merge", "c3discard", "c4create", "c4link", "c5discard"}
    # all are rejected; the pairs of merges are decided, that of the link is not
    from loomwright.operators import proposals

    log = proposals.record(out, F.lit(False), F.lit(NOW))
    assert log.columns == [f.split()[0] for f in " ".join(DECISION.split()).split(", ")]
    pairs = judged.select(F.least("candidate", "other").alias("left_id"), F.greatest("candidate", "other").alias("right_id"))
    assert [r.left_id for r in merge.undecided(pairs, ledger.decided_pairs(log)).collect()] == ["c4"]


def test_bodies_stay_where_they_are_until_the_end(spark, monkeypatch):
    wrote = {}
    monkeypatch.setattr(review, "written", lambda df, name: wrote.setdefault(name, []).append(df) or df.localCheckpoint())
    held = [node("n1"), node("n2")]
    asked = [proposal("p1", "create", candidate="c1"), proposal("p2", "merge", winner="n1", loser="c2", outcome="SAME", body_md="new")]
    said = spark.createDataFrame([(p["id"], True, NOW, None) for p in asked], "proposal_id string, approved boolean, decided_at timestamp, note string")
    out = review.review(frame(spark, held), frame(spark, [node("c1"), node("c2")]), frame(spark, asked, PROPOSAL, FIELDS), said, None, spark.createDataFrame([], "node_id string"), F.lit(NOW))
    assert {r["id"]: r["body_md"] for r in out.nodes.collect()} == {"n1": "new", "n2": "body n2", "c1": "body c1"}
    assert [(r["node_id"], r["body_md"]) for r in out.archived.collect()] == [("c2", "body c2")]
    bodies = {"new", *(f"body {i}" for i in ("n1", "n2", "c1", "c2"))}
    with_bodies = {name for name, dfs in wrote.items() for df in dfs if "body_md" in df.columns and any(r["body_md"] in bodies for r in df.select("body_md").collect())}
    assert with_bodies == {"nodes", "archived"} and "body_md" not in wrote["decided"][0].columns
