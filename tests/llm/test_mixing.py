import pytest
from pyspark.sql import functions as F

from tessel.llm import mixing, queries

DOCUMENTS = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, weight double, max_repeats int"


def brute(spark, documents, targets, budget=None, seed=17):
    """The same order by plain sorting on the driver."""
    docs = {d: (s, n) for d, s, n in documents if n and n > 0}
    wanted = {s: (w, m) for s, w, m in targets if s is not None and w and w > 0 and m and m >= 1}
    tokens = {}
    for s, n in docs.values():
        tokens[s] = tokens.get(s, 0) + n
    live = {s: v for s, v in wanted.items() if tokens.get(s)}
    total = sum(w for w, _ in live.values())
    share = {s: w / total for s, (w, _) in live.items()}
    if budget is None:
        budget = int(min((tokens[s] * m / share[s] for s, (_, m) in live.items()), default=0))
    pairs = [(d, p) for d, (s, _) in docs.items() if s in live for p in range(live[s][1])]
    if not pairs:
        return {}
    df = spark.createDataFrame(pairs, "doc_id bigint, p int").select("doc_id", "p", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "p", "doc_id"), 33).alias("dice"))
    dice = {(r.doc_id, r.p): r.dice for r in df.collect()}
    uses = []
    for s in live:
        upto = 0
        for d, p in sorted((x for x in pairs if docs[x[0]][0] == s), key=lambda x: (x[1], dice[x], x[0])):
            upto += docs[d][1]
            uses.append((upto / share[s], s, d, p))
    out, used = {}, 0
    for _, _, d, _ in sorted(uses):
        used += docs[d][1]
        if used > budget:
            break
        out[d] = out.get(d, 0) + 1
    return out


def run(spark, documents, targets, **kw):
    out = mixing.mix(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(targets, TARGETS), **kw)
    return {r.doc_id: r.uses for r in out.collect()}


MANY = [(k, ("big", "mid", "small", "none", None)[min(k % 11, 4) if k % 3 else 0], (k * 37) % 200) for k in range(900)]
GOALS = [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.15, 5), ("absent", 0.05, 3)]


@pytest.mark.parametrize("budget", [None, 0, 1, 500, 20_000, 10**9])
def test_equals_plain_sorting(spark, budget):
    assert run(spark, MANY, GOALS, budget=budget) == brute(spark, MANY, GOALS, budget)


def test_ranges_do_not_change_the_choice(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    assert run(spark, MANY, GOALS) == brute(spark, MANY, GOALS)


def test_one_source_with_a_third_of_the_rows_and_joins_beyond_broadcast(spark, monkeypatch):
    from tessel import scale

    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    assert run(spark, MANY, GOALS) == brute(spark, MANY, GOALS)


def test_shares_and_caps(spark, sf):
    documents = queries._sized(spark, sf)
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet")
    chosen = queries.p8_mix(spark, sf)
    caps = {r.source: r.max_repeats for r in targets.collect()}
    most = max(r.n_tokens for r in documents.collect())
    rows = chosen.collect()
    assert rows and all(1 <= r.uses <= caps[r.source] for r in rows)
    total = sum(r.n_tokens * r.uses for r in rows)
    for r in mixing.shares(documents, targets, chosen).collect():
        if r.target_share is not None:
            assert abs(r.actual_share - r.target_share) * total <= most * (1 + len(caps) * r.target_share)
        else:
            assert r.actual_share == 0


@pytest.mark.parametrize(
    ("documents", "targets"),
    [
        ([], GOALS),
        (MANY, []),
        ([(1, None, 5), (2, "x", 0), (3, "x", None)], [("x", 1.0, 2), (None, 0.5, 1)]),
        ([(1, "x", 5)], [("x", 0.0, 2), ("y", None, 1)]),
        ([(1, "x", 5)], [("x", 1.0, 0)]),
    ],
)
def test_nothing_to_choose_from(spark, documents, targets):
    assert run(spark, documents, targets) == {} == brute(spark, documents, targets)


def test_repeated_rows_and_clashing_columns(spark):
    documents = spark.createDataFrame(MANY + MANY[:300], DOCUMENTS).withColumns({"share": F.lit(1), "_range": F.lit(2), "uses": F.lit("u"), "tokens": F.lit(0)})
    targets = spark.createDataFrame(GOALS + GOALS, TARGETS).withColumns({"tokens": F.lit(9), "documents": F.lit(1), "doc_id": F.lit(1)})
    assert {r.doc_id: r.uses for r in mixing.mix(documents, targets).collect()} == brute(spark, MANY, GOALS)
