"""Line dedup by winnowing over line hashes, in Spark expressions only.

Lines that are not blank are hashed. A window starts at each line and is as long as a repeat must be to count: LINES lines, or fewer if they hold
WORDS words. The least line hash of a window is its fingerprint; windows next to each other mostly share one, so few positions are selected, and any
two equal windows select the same. Fingerprints selected at least twice in the corpus are joined back to the windows that select them; these
windows are compared, each with the first of its kind in the order (doc_id, text hash, line). A seed that repeats an earlier window is extended both
ways, as long as the next window repeats an earlier one too; the lines of these runs are deleted where they come later.

A line of ALONE words or more that is shorter than such a window is a window by itself too, which counts if it stands at OFTEN places of the corpus or more:
a notice between paragraphs that differ. A line that only a few documents share is left to the windows, as it is mostly prose of near copies.

Of a line of more than WORDS words the first and the last WORDS words are windows too, which count at two places, as heads or as tails: a passage set before or behind a paragraph's own
words. Where they come later these words go and the rest of the line stays (an empty line, if nothing is left).

So a line is deleted exactly if some window over it is equal to an earlier window that counts, in this or another document. Keys of documents and windows have 128 bits.
A very common window or fingerprint is no task's own: the few keys with many rows are broadcast, the others shuffled.

Defined results: a null text stays null; lines are compared without blanks at their ends, blank lines are kept and never counted; rows with the same doc_id and text are one
document, each row keeps what it keeps; a null doc_id comes first; texts of any length are taken whole, in time linear in their lines; an empty table gives no rows; other columns pass
through in drop_repeated_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, join_counted, own_name, table

LINES, WORDS = 3, 50
#: A word with the white space ahead of it.
SPACED = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
ALONE, OFTEN = 5, 10


def _key(doc_id="doc_id", text="text") -> Column:
    """128 bits of a document."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), doc_id, text).alias("b"))


def _hashes(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: its key, and for its lines that are not blank place, two hashes, number of words and, beyond so many words, hashes of the first and last of them."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")
    first = rf"^(?:{SPACED}){{{words}}}"

    def ends(x: Column) -> Column:
        both = F.array(F.regexp_substr(x, F.lit(first)), F.reverse(F.regexp_substr(F.reverse(x), F.lit(first))))
        return F.transform(both, lambda e: F.trim(F.regexp_replace(e, r"[\x20\x09-\x0D]+", " ")))

    def marks(s: Column) -> Column:
        both = F.transform(ends(s["x"]), lambda e: F.struct(F.xxhash64(e).alias("h"), F.xxhash64(F.lit(1), e).alias("g")))
        return F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(1), s["x"]).alias("g"), s["w"].alias("w"), F.when(s["w"] > words, both).alias("e"))

    counted = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"), F.regexp_count(s["x"], F.lit(WORD)).alias("w")))
    hashed = F.transform(counted, marks)
    return docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("k"), hashed.alias("l"))


def _at(p: Column, name: str) -> Column:
    return F.get("l", p)[name]


def _windows(lines: int, words: int) -> Column:
    """Of the array l: start p (in l), length n, least number of places that counts, fingerprint f, its place, and 128 bits of the whole, for every start where a whole window fits."""

    def window(p: Column) -> Column:
        n, total = F.lit(lines), F.lit(0)
        sums = []
        for j in range(lines):
            total = total + F.coalesce(_at(p + j, "w"), F.lit(0))
            sums.append(total)
        for j in reversed(range(lines - 1)):
            n = F.when(sums[j] >= words, F.lit(j + 1)).otherwise(n)
        return F.struct(p.alias("p"), n.alias("n"))

    def marked(s: Column) -> Column:
        own = F.transform(F.slice("l", s["p"] + 1, s["n"]), lambda x, j: F.struct(x["h"].alias("h"), (-j).alias("j")))
        least = F.array_min(own)
        body = lambda name: F.transform(F.slice("l", s["p"] + 1, s["n"]), lambda x: x[name])
        return F.struct(s["p"].alias("p"), s["n"].alias("n"), F.lit(2).alias("need"), least["h"].alias("f"), (s["p"] - least["j"]).alias("at"), F.xxhash64(body("h")).alias("w1"), F.xxhash64(body("g")).alias("w2"))

    starts = F.transform(F.sequence(F.lit(0), F.size("l")), window)
    return F.transform(F.filter(starts, lambda s: s["p"] + s["n"] <= F.size("l")), marked)


def _lone(lines: int, words: int, alone: int, often: int) -> tuple[Column, Column]:
    """Of the lines of l that are windows by themselves: fingerprints with their places, and windows as those of _windows."""
    places = F.filter(F.sequence(F.lit(0), F.size("l")), lambda p: _at(p, "w").between(alone, words - 1) if lines > 1 else F.lit(False))
    marks = F.transform(places, lambda p: F.struct(_at(p, "h").alias("f"), p.alias("at")))
    whole = lambda p: F.struct(p.alias("p"), F.lit(1).alias("n"), F.lit(often).alias("need"), _at(p, "h").alias("f"), p.alias("at"), _at(p, "h").alias("w1"), _at(p, "g").alias("w2"))
    return marks, F.transform(places, whole)


def _ends() -> Column:
    """Heads and tails of the lines of l, as windows like those of _windows: length 0, start twice the line's place, and one more for a tail."""

    def window(x: Column, p: Column) -> Column:
        side = lambda e, j: F.struct((2 * p + j).alias("p"), F.lit(0).alias("n"), F.lit(2).alias("need"), e["h"].alias("f"), (2 * p + j).alias("at"), e["h"].alias("w1"), e["g"].alias("w2"))
        return F.transform(x["e"], side)

    return F.flatten(F.filter(F.transform("l", window), lambda x: x.isNotNull()))


def repeated_lines(docs: DataFrame, lines: int = LINES, words: int = WORDS, alone: int = ALONE, often: int = OFTEN) -> DataFrame:
    """k (document key), places (of the lines of its text to delete, from 0), heads and tails (of the lines whose first or last words go)."""
    hashed = cut(cut(_hashes(docs, words)).withColumn("win", F.concat(_windows(lines, words), _ends())).withColumn("l", F.transform("l", lambda x: x.dropFields("e"))).filter(F.size("l") > 0).dropDuplicates(["k"]))
    marks, whole = _lone(lines, words, alone, often)
    windows = hashed.select("doc_id", "k", F.explode(F.concat("win", whole)).alias("s")).select("doc_id", "k", "s.*")
    positions = hashed.select(F.explode(F.array_distinct(F.concat(F.transform("win", lambda s: F.struct(s["f"].alias("f"), s["at"].alias("at"))), marks))).alias("s")).select("s.f")
    shared = cut(positions.groupBy("f").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    n = hashed.agg(F.coalesce(F.sum(F.size("win") + F.size(marks)), F.lit(0))).first()[0]
    # A line by itself always selects its own place, so c is at least the number of places it stands at.
    found = cut(join_counted(windows, shared, ["f"], n).filter("c >= need").select("doc_id", "k", "p", "n", "need", "w1", "w2"))
    counted = found.groupBy("w1", "w2", "n").agg(F.min(F.struct("doc_id", "k", "p")).alias("first"), F.count(F.lit(1)).alias("c"), F.max("need").alias("least"))
    first = cut(counted.filter("c >= least").drop("least"))
    later = join_counted(found, first, ["w1", "w2", "n"], found.count()).filter(~F.struct("doc_id", "k", "p").eqNullSafe(F.col("first")))
    # Windows next to each other make runs; a run's lines are deleted.
    cover = later.groupBy("k").agg(F.collect_set(F.struct("p", "n")).alias("c"))
    runs = hashed.select("k", F.transform("l", lambda x: x["i"]).alias("at")).join(cover, "k")
    ends = lambda side: F.transform(F.filter("c", lambda s: (s["n"] == 0) & (s["p"] % 2 == side)), lambda s: F.get("at", F.shiftright(s["p"], 1)))
    return runs.select("k", F.array_distinct(F.flatten(F.transform("c", lambda s: F.slice("at", s["p"] + 1, s["n"])))).alias("places"), ends(0).alias("heads"), ends(1).alias("tails"))


def drop_repeated_lines(docs: DataFrame, lines: int = LINES, words: int = WORDS, counts: bool = False, alone: int = ALONE, often: int = OFTEN) -> DataFrame:
    """docs with the lines deleted from text; with counts, n_lines and n_removed come behind."""
    k, places, heads, tails = (own_name(docs, c) for c in ("k", "places", "heads", "tails"))
    gone = repeated_lines(docs, lines, words, alone, often).select(F.col("k").alias(k), F.col("places").alias(places), F.col("heads").alias(heads), F.col("tails").alias(tails))
    rows = docs.withColumn(k, _key(F.col("doc_id").cast("long"), F.col("text"))).join(gone, k, "left")

    def rest(x: Column, i: Column) -> Column:
        head, tail = F.array_contains(heads, i), F.array_contains(tails, i)
        lo, hi = F.when(head, words).otherwise(0), F.when(tail, words).otherwise(0)
        left = F.transform(F.array(F.regexp_extract_all(x, F.lit(SPACED), F.lit(0))), lambda v: F.array_join(F.slice(v, lo + 1, F.greatest(F.size(v) - lo - hi, F.lit(0))), ""))
        return F.when(head | tail, F.regexp_replace(F.get(left, F.lit(0)), r"^[\x20\x09-\x0D]+", "")).otherwise(x)

    def kept(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(places))
        return F.array_join(F.transform(left, lambda i: F.when(F.size(heads) + F.size(tails) > 0, rest(F.get(x, i), i)).otherwise(F.get(x, i))), "\n")

    # Bound by a transform, so that the text is split once.
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n")), kept), F.lit(0)))
    more = [F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], *more)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
l AS (
  SELECT doc_id, i, trim(line) AS x, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM raw WHERE trim(line) <> ''),
g AS (
  SELECT doc_id, p, x, w, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, coalesce(lead(w, 1) OVER o, 0) AS w1, count(*) OVER (PARTITION BY doc_id) AS c
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
win AS (
  SELECT doc_id, p, CASE WHEN w >= 50 THEN 1 WHEN w + w1 >= 50 THEN 2 ELSE 3 END AS n, x, x1, x2, c FROM g),
keyed AS (
  SELECT doc_id, p, n, CASE n WHEN 1 THEN x WHEN 2 THEN x || chr(10) || x1 ELSE x || chr(10) || x1 || chr(10) || x2 END AS body
  FROM win WHERE p + n - 1 <= c
  UNION ALL SELECT doc_id, p, 0, x FROM l WHERE w BETWEEN 5 AND 49
  UNION ALL SELECT doc_id, 2 * p + side, -1, array_to_string(CASE WHEN side = 0 THEN v[:50] ELSE v[-50:] END, ' ')
    FROM (SELECT doc_id, p, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS v FROM l WHERE w > 50), (SELECT unnest([0, 1]) AS side)),
again AS (
  SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, body ORDER BY doc_id, p) AS r, count(*) OVER (PARTITION BY n, body) AS places FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + greatest(n, 1))) AS p FROM again WHERE r > 1 AND (n > 0 OR n = 0 AND places >= 10)),
ends AS (SELECT l.doc_id, l.i, 50 * max((again.p % 2 = 0)::INT) AS lo, 50 * max((again.p % 2 = 1)::INT) AS hi FROM again JOIN l ON n = -1 AND r > 1 AND again.doc_id = l.doc_id AND again.p // 2 = l.p GROUP BY ALL),
gi AS (SELECT l.doc_id, l.i FROM gone JOIN l ON gone.doc_id = l.doc_id AND gone.p = l.p),
kept AS (
  SELECT raw.doc_id, string_agg(CASE WHEN lo IS NULL THEN raw.line ELSE regexp_replace(array_to_string(t[lo + 1 : len(t) - hi], ''), '^[\x20\x09-\x0D]+', '') END, chr(10) ORDER BY raw.i) AS text, count(*) AS n
  FROM (SELECT *, regexp_extract_all(line, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS t FROM raw) raw LEFT JOIN gi ON raw.doc_id = gi.doc_id AND raw.i = gi.i LEFT JOIN ends ON raw.doc_id = ends.doc_id AND raw.i = ends.i WHERE gi.i IS NULL GROUP BY raw.doc_id)
SELECT documents.doc_id, coalesce(len(d.ls), 0)::BIGINT AS n_lines, (coalesce(len(d.ls), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id LEFT JOIN kept ON documents.doc_id = kept.doc_id
"""
