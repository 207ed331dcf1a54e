from pyspark.sql import functions as F

from tracelake.operators import display, profile
from tracelake.sources import files


def test_blocks_and_syntax():
    t = "system「a」🏷 s\n\nplan {\n  x ↦ 1\n}\nloose\nact {\n"
    assert display.blocks(t) == [("system", "system「a」🏷 s"), ("plan", "plan {\n  x ↦ 1\n}"), ("", "loose"), ("act", "act {")]
    s = 'plan { 1 ↦ "id" • x } 🏷 t ※ [a • b] ⊨ 2 𝑝 0.5 // c'
    assert [(k, s[a:b]) for k, a, b in display.syntax(s)] == [("keyword", "plan"), ("operator", "↦"), ("string", '"id"'), ("operator", "•"), ("tag", "🏷 t"), ("reference", "※ [a • b]"), ("satisfies", "⊨ 2"), ("confidence", "𝑝 0.5"), ("comment", "// c")]


def test_syntax_rows(spark):
    texts = ["plan { 1 ↦ 「é」 }", None, "", "no tokens here 日本", "act act"] * 30
    df = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "key string, text string, class int").repartition(3)
    got = sorted(((r.key, r["class"], r.start, r.end, r.token) for r in display.syntax_rows(df, "key", "text").collect()), key=lambda x: (int(x[0]), x[2]))
    assert got == [(str(i), c, a, b, t[a:b]) for i, t in enumerate(texts) for c, a, b in display.syntax(t or "")]
    assert display.syntax_rows(df.limit(0), "key", "text").count() == 0


def test_block_rows(spark):
    df = spark.createDataFrame([("user「a」\nact { }",), (None,)], "t string")
    got = df.select(F.explode(display.block_rows("t")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in got] == [("user", "user「a」"), ("act", "act { }")]


def test_token_cache_follows_content(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def encode(ts):
        (calls / str(len(list(calls.iterdir())))).write_text("")
        return [[1] * len(t) for t in ts]

    one = spark.createDataFrame([("a" * 200,)], "t string")
    first = profile.cached_tokenized(one, "t", encode, 150, str(tmp_path / "c"), "n")
    n = len(list(calls.iterdir()))
    again = profile.cached_tokenized(one, "t", encode, 150, str(tmp_path / "c"), "n")
    assert n and len(list(calls.iterdir())) == n and first.collect() == again.collect() and len(again.first().input_ids) == 150
    profile.cached_tokenized(spark.createDataFrame([("b" * 200,)], "t string"), "t", encode, 150, str(tmp_path / "c"), "n")
    assert len(list(calls.iterdir())) > n


def test_tokenizers_get_texts_of_bounded_size(spark):
    """However many texts a batch has, few are Python objects at once."""
    df = spark.createDataFrame([(i, "é" * 5000 if i % 3 else None) for i in range(600)], "i int, t string").repartition(1)
    count = profile.counted_by(lambda ts: [len(ts) if t else 0 for t in ts])
    ids = profile.tokenized(df, "t", lambda ts: [[len(ts)] * 2 for _ in ts], most=9, least=1).collect()
    counts = {r.i: r.n for r in df.select("i", count("t").alias("n")).collect()}
    assert len(ids) == 400 and len(counts) == 600 and all((counts[i] > 0) == (i % 3 > 0) for i in counts)
    assert max(r.input_ids[0] for r in ids) <= 40 and max(counts.values()) <= 60


def test_latest_checkpoint(spark, tmp_path):
    for n in ("checkpoint-9", "checkpoint-10", "checkpoint-x", "other"):
        (tmp_path / n).mkdir()
    assert files.latest_checkpoint(spark, str(tmp_path)).endswith("/checkpoint-10") and files.latest_checkpoint(spark, str(tmp_path / "other")) is None
