"""Grouping of spelling variants: frequent words that differ by one character, each led to its most common neighbour.

One error lies either in the first half of a word or behind it, so the other half stands unchanged at the beginning or at
the end of every near word. Words are therefore searched twice: in minimal acyclic automata of the words as they are, with
the first half matched exactly and the rest completed with one error, and in automata of the reversed words, with the
second half matched exactly. The automata number their words, and counts are kept by these numbers. A near word that has
the first half in common is found going forward, whatever else it shares, so the backward search leaves it out and no pair
is met twice.

Words are dealt to automata by their first (last) three characters, which every half includes. Blocks of such words are
hashed into shards of limited size; a larger block is cut into several automata, each of its words stands in one of them
and is looked up in all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 6
LEAST = 5
RATIO = 5
CUT = 199
SHARD = 20_000

UPPER, LOWER = ("".join(map(chr, range(ord(a), ord(a) + 26))) for a in "Aa")


class Automaton:
    """The minimal acyclic automaton of distinct words, given in ascending order, which are numbered in this order.

    edges[state] leads from a letter to the next state and to the number of this state's words that come before that edge.
    """

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]  # states of the last word: whether a word ends there, and the edges so far
        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            self._close(path, last, same)
            path += [[False, {}] for _ in word[same:]]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.root = self._state(*path[0])

    def _close(self, path: list[list], word: str, keep: int) -> None:
        for i in range(len(word), keep, -1):
            path[i - 1][1][word[i - 1]] = self._state(*path.pop())

    def _state(self, final: bool, to: dict[str, int]) -> int:
        """The one state with this end mark and these edges."""
        key = (final, *to.items())
        if key not in self._known:
            before, edges = int(final), {}
            for letter, state in to.items():
                edges[letter] = (state, before)
                before += self._sizes[state]
            self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self._sizes.append(before)
        return self._known[key]

    def _finish(self, state: int, number: int, word: str, at: int) -> int | None:
        """Number of the word that goes on from state exactly like word from at."""
        while at < len(word):
            step = self.edges[state].get(word[at])
            if not step:
                return None
            state, number, at = step[0], number + step[1], at + 1
        return number if self.final[state] else None

    def near(self, word: str, exact: int) -> Iterator[int]:
        """Numbers of the words that agree with word in its first letters and differ by one error behind them, each once."""
        state, number, length = self.root, 0, len(word)
        for i in range(length + 1):
            if i >= exact:
                for letter, (to, before) in self.edges[state].items():
                    if i == length or letter != word[i]:  # an inserted letter is placed behind its equals
                        yield self._finish(to, number + before, word, i)
                        if i < length:
                            yield self._finish(to, number + before, word, i + 1)
                if i < length and (i == exact or word[i] != word[i - 1]):  # of equal letters the first one is left out
                    yield self._finish(state, number, word, i + 1)
            step = self.edges[state].get(word[i]) if i < length else None
            if not step:
                return
            state, number = step[0], number + step[1]


FOUND = "word string, n_near long, form_n long, form string"


def _search(rows: pa.Table) -> pa.Table:
    """Look up all words of a shard in the automaton of those it holds. rows: back, word (reversed if back), n, held."""
    back = rows["back"][0].as_py()
    held = rows.filter(rows["held"]).sort_by("word")
    words, counts = held["word"].to_pylist(), held["n"].to_pylist()  # Arrow sorts by UTF-8, which is code point order
    automaton, out = Automaton(words), []
    for word in rows["word"].to_pylist():
        half = len(word) // 2
        found = [i for i in automaton.near(word, len(word) - half if back else half) if i is not None]
        if back:
            found = [i for i in found if words[i][-half:] != word[-half:]]
        if found:
            turn = slice(None, None, -1 if back else 1)
            n, form = min((-counts[i], words[i][turn]) for i in found)
            out.append((word[turn], len(found), -n, form))
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])})


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, cut: int = CUT) -> DataFrame:
    """word, n: the words of whole texts with at least so many letters and occurrences.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z is lower-cased). One of cut occurrences, by a
    hash of doc_id and word, has a letter left out first; a null doc_id hashes as the empty string, and cut=0 leaves all words whole. Null and empty
    texts have no words; repeated rows count as often as they occur. Other columns are not read.
    """
    runs = docs.select(F.col("doc_id").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("word"))
    runs = runs.select("doc_id", F.translate("word", UPPER, LOWER).alias("word"))
    if cut:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        without = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % cut == 0, without).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n, of equals the smallest) for words with near ones.

    words: distinct words of at least six letters, and n; a written table, as it is read several times.
    """
    total = words.count()
    both = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "word", "n").withColumn("word", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    both = both.withColumn("block", F.left("word", F.lit(SHORTEST // 2)))
    parts = both.groupBy("back", "block").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")).where("parts > 1")
    dealt = both.join(small(materialise(parts, "parts")), ["back", "block"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.lit(-1)))))
    common = F.pmod(F.xxhash64("block"), F.lit(max(1, ceil(total / shard)))).cast("string")
    name = F.concat_ws(":", F.col("back").cast("string"), F.when(F.col("part") < 0, common).otherwise(F.concat_ws(":", F.lit("block"), "block", F.col("part").cast("string"))))
    rows = dealt.select(name.alias("shard"), "back", "word", "n", ((F.col("part") < 0) | (F.col("part") == own)).alias("held"))
    found = rows.groupBy("shard").applyInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for (word, form) rows: the end of the chain of forms. Each round doubles the distance looked ahead."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, shard: int = SHARD, **how) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Two words are near if they differ by one inserted, deleted or replaced letter. A word's form is its most frequent near
    word (ties: the smallest by code point), if that is at least ratio times as frequent as the word; else null, as is form_n. root:
    the last word reached by following forms, the word itself if it has none. Counts grow by the ratio with every step, so
    chains are short and never closed. No words, no rows.
    """
    words = materialise(vocabulary(docs, **how), "vocabulary")
    near = neighbours(words, shard).withColumnRenamed("word", "w")
    joined = words.join(near, F.col("word") == F.col("w"), "left").drop("w")
    fits = F.col("form_n") >= ratio * F.col("n")
    out = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    top = roots(out.where("form is not null"))
    return out.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, x)) AS tab),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
p AS (SELECT word, n, list_transform(range(1, length(doc) + length(word) + 2), lambda i: unicode(substr(doc || ':' || word, i, 1))) AS points FROM r),
y AS (SELECT word, n, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END)) AS bytes FROM p),
h AS (SELECT word, n, xor(4294967295, list_reduce(list_transform(bytes, lambda x: x::BIGINT), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1]), 4294967295)) AS h FROM y, c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) u(i)),
q AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS form, max(n) AS form_n FROM q GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
z AS (SELECT word, word AS root, form AS more FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.more = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word AND z.more IS NULL
"""
