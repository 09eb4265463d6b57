"""Line dedup: later copies of repeated line runs, by prefix doubling over line sequences.

DataFrame functions only. A document is the sequence of its lines (`text` split at \\n), and
the corpus is the sequence of documents by key. Positions are numbered in that order.

1. Lines: every line is named by the first position of an equal line; lines that occur once
   drop out, so what follows moves repeated lines only.
2. Prefix doubling: the name of 2h lines at a position is the first position of the same pair
   (name of h lines here, name of h lines h further on). Positions with one name are the
   suffixes that share that prefix, an interval of the suffix array with a longest common
   prefix of 2h or more; names hold its least position instead of its rank, as only equality
   and the first copy matter. Prefixes that occur once drop out in every round.
3. A run is the shortest one from a position with `min_words` words. Its interval is found from
   the names of the two power-of-two prefixes that cover it. Where the interval begins
   earlier, the run is a later copy. Runs that touch or overlap join to longer ones.
   With `maximal` the shortest run that ends at each line counts as well. The two together
   cover every repeated run of `min_words` words to its last line: of such a run the shortest
   ones from its lines, and the shortest one that ends with it, all lie inside it. Without it
   (as the SQL of `op9_line_dedup` has it) lines behind the last full run from a line stay.
4. The lines of later copies are deleted; all else stays, in order.

The rounds end with the longest run that `min_words` needs, or when nothing repeats any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.operators.keys import dense_ids
from casewell.session import stage

# Lines of a document that a position can count; documents are numbered above these bits.
LINE_BITS = 28
LONGEST = 1 << LINE_BITS
# Parts to which the rows of one name are dealt.
SALTS = 32


def _words_of(line: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a line."""
    return F.size(F.filter(F.split(line, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: key, `_hash` of the text, and its lines as (a, b, words).

    a and b are two independent hashes, 96 bits that stand for the line.
    """
    lines = F.split(df[text], "\n")
    named = F.transform(
        lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x, F.length(x)).alias("b"), _words_of(x).alias("words"))
    )
    known = df.filter(df[key].isNotNull() & df[text].isNotNull())
    return known.select(df[key].alias("_key"), F.xxhash64(df[text]).alias("_hash"), named.alias("lines"))


def run_lengths(words: str, least: int) -> Column:
    """For each line the length of the shortest run from it with `least` words, or null.

    Sums up to each line by doubling, then a binary search in them: n log n for n lines.
    """
    sums = (
        f"aggregate(sequence(0, cast(ceil(log2(size({words}) + 1)) as int)), concat(array(0L), transform({words}, w -> cast(w as bigint))), "
        "(p, k) -> transform(p, (x, i) -> x + if(i >= shiftleft(1, k), p[i - shiftleft(1, k)], 0L)))"
    )
    search = (
        f"transform(sequence(0, size({words}) - 1), i -> aggregate(sequence(0, cast(ceil(log2(size({words}) + 1)) as int)), "
        f"struct(i as low, size({words}) as high), (s, k) -> if(s.low >= s.high, s, "
        f"if(sums[cast((s.low + s.high) div 2 as int)] >= sums[i] + {least}, struct(s.low as low, cast((s.low + s.high) div 2 as int) as high), "
        "struct(cast((s.low + s.high) div 2 as int) + 1 as low, s.high as high))), "
        f"s -> if(sums[size({words})] >= sums[i] + {least}, s.low - i, null)))"
    )
    # The array of sums is computed once per row and then named inside the search.
    return F.expr(f"element_at(transform(array({sums}), sums -> {search}), 1)")


def run_spans(lengths: Column, size: Column) -> Column:
    """(length, most) per line: from the shortest run there to the longest of those that start
    there and are the shortest that end at their last line, or null.

    The run from the next line ends where runs from this one cease to be the shortest. Over
    all lines these are at most two runs a line.
    """
    return F.transform(
        F.array(lengths),
        lambda all_: F.transform(
            all_,
            lambda x, i: F.when(
                x.isNotNull(), F.struct(x.alias("length"), F.greatest(x, F.coalesce(F.get(all_, i + 1), size - i)).alias("most"))
            ),
        ),
    )[0]


def _with_first(rows: DataFrame, *name: str) -> DataFrame:
    """Rows whose name stands at more than one position, with `first`, its least one.

    A name may stand at a third of all positions, so its rows are dealt to `SALTS` parts by
    their position. Every part learns its name's least position from at most `SALTS` rows.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    parts = dealt.groupBy(*name, "_salt").agg(F.min("at").alias("_low"), F.max("at").alias("_high"))
    of_name = Window.partitionBy(*name)
    ends = parts.select(
        *name, "_salt", F.min("_low").over(of_name).alias("first"), F.max("_high").over(of_name).alias("_last")
    )
    return dealt.join(ends.filter("first < _last").drop("_last"), [*name, "_salt"]).drop("_salt")


def doubled(names: DataFrame, h: int) -> DataFrame:
    """(at, name) of the repeated prefixes of 2h lines from those of h lines."""
    ahead = names.select((F.col("at") - h).alias("at"), F.col("name").alias("next"))
    pairs = names.join(ahead, "at")
    rest = [c for c in names.columns if c not in ("at", "name")]
    return _with_first(pairs, "name", "next").select("at", F.col("first").alias("name"), *rest)


def later_copies(names: DataFrame, h: int) -> DataFrame:
    """(at, length) of runs of h to 2h - 1 lines whose interval begins earlier."""
    if "most" in names.columns:
        some = names.filter((F.col("length") < 2 * h) & (F.col("most") >= h))
        each = F.explode(F.sequence(F.greatest("length", F.lit(h)), F.least("most", F.lit(2 * h - 1))))
        own = some.select("at", "name", each.alias("length"))
    else:
        own = names.filter(F.col("length").between(h, 2 * h - 1))
    tails = names.select(F.col("at").alias("_tail"), F.col("name").alias("tail"))
    runs = own.withColumn("_tail", F.col("at") + F.col("length") - h).join(tails, "_tail").drop("_tail")
    return _with_first(runs, "name", "tail", "length").filter("at > first").select("at", "length")


def repeated_runs(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, maximal: bool = False
) -> DataFrame:
    """Later copies as joined runs of lines: `_key`, `_hash`, `runs` (start, stop; from 0, stop
    excluded, in order), for documents that have any.

    Rows with the same key and text are one document; different texts of one key stand in the
    order of their hash. Rows without a key or text take no part.
    """
    documents = stage(line_rows(df, key, text), "lines")
    order = dense_ids(documents.select("_key", "_hash").distinct(), ["_key", "_hash"], "_number", 0)
    lengths = run_lengths("lines.words", min_words)
    spans = run_spans(lengths, F.size("lines")) if maximal else lengths
    numbered = documents.join(order, ["_key", "_hash"]).select("_number", "lines", spans.alias("spans"))
    cell = F.posexplode(F.arrays_zip(F.col("lines.a").alias("a"), F.col("lines.b").alias("b"), F.col("spans").alias("span")))
    span = [F.col("_it.span.length"), F.col("_it.span.most")] if maximal else [F.col("_it.span").alias("length")]
    lines = stage(
        numbered.select("_number", cell.alias("_line", "_it")).select(
            (F.shiftleft("_number", LINE_BITS) + F.col("_line")).alias("at"), "_it.a", "_it.b", *span
        ),
        "line-rows",
    )
    names = stage(_with_first(lines, "a", "b").drop("a", "b").withColumnRenamed("first", "name"), "names")
    h, found = 1, None
    while True:
        copies = stage(later_copies(names, h), "copies")
        found = copies if found is None else found.unionByName(copies)
        longer = names.agg(F.max("most" if maximal else "length")).first()[0]
        if longer is None or longer < 2 * h:
            break
        names = stage(doubled(names, h), "names")
        h *= 2
    place = Window.partitionBy("_number").orderBy("start", "stop")
    number, line = F.shiftright("at", LINE_BITS), F.col("at").bitwiseAND(LONGEST - 1)
    spans = found.select(number.alias("_number"), line.alias("start"), (line + F.col("length")).alias("stop")).distinct()
    reach = F.max("stop").over(place.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("_number", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    per_document = joined.groupBy("_number").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    return per_document.join(order, "_number").select("_key", "_hash", "runs")


def drop_repeated_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, maximal: bool = False
) -> DataFrame:
    """All rows and columns of `df`, with the lines of later copies taken out of `text`, and
    `_runs` (null where nothing was). A text of which no line stays is empty.

    A run of lines counts if it has `min_words` words; all of it goes if `maximal`. Its first copy in the order of keys
    stays, also where copies overlap. Null and empty texts and rows without a key stay as
    they are.
    """
    runs = repeated_runs(df, key, text, min_words, maximal)
    own = df.withColumn("_hash", F.xxhash64(df[text])).withColumn("_key", F.col(key))
    joined = own.join(runs, ["_key", "_hash"], "left").drop("_key", "_hash")
    lines = F.split(F.col(text), "\n")
    # What stays lies between the end of one run and the start of the next.
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("runs.stop"))
    stops = F.concat(F.col("runs.start"), F.array(F.size(lines).cast("bigint")))
    kept = F.flatten(
        F.transform(
            F.arrays_zip(starts.alias("from"), stops.alias("to")),
            lambda r: F.slice(lines, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")),
        )
    )
    changed = F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    rest = [changed.alias(c) if c == text else F.col(c) for c in df.columns]
    return joined.select(*rest, F.col("runs").alias("_runs"))


def line_dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, maximal: bool = False
) -> DataFrame:
    """One row per row of `df`: `key`, `n_deleted` lines, the `text` that stays, and `kept`: a
    document goes if lines were deleted and no word stays."""
    done = drop_repeated_lines(df.select(df[key], df[text]), key, text, min_words, maximal)
    deleted = F.aggregate("_runs", F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["start"])
    return done.select(key, F.coalesce(deleted, F.lit(0).cast("bigint")).alias("n_deleted"), text, stays(text).alias("kept"))


def stays(text: str) -> Column:
    """Whether a row of `drop_repeated_lines` still has a word, or lost nothing."""
    return F.col("_runs").isNull() | F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


ORACLE = """
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, l
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), counted AS (
    SELECT doc_id, i, l, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))
        OVER (PARTITION BY doc_id ORDER BY i) AS upto,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
    FROM lines
), runs AS (
    SELECT a.doc_id, a.i, a.l, (SELECT min(b.i) FROM counted b
        WHERE b.doc_id = a.doc_id AND b.i >= a.i AND b.upto >= a.upto - a.w + 50) AS j
    FROM counted a
), copies AS (
    SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(l[i:j], chr(10)) ORDER BY doc_id, i) AS nth
    FROM runs WHERE j IS NOT NULL
), marked AS (
    SELECT x.doc_id, x.i, x.line, EXISTS (SELECT 1 FROM copies c
        WHERE c.nth > 1 AND c.doc_id = x.doc_id AND x.i BETWEEN c.i AND c.j) AS gone
    FROM lines x
), left_over AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_deleted,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(o.n_deleted, 0)::BIGINT AS n_deleted,
    CASE WHEN d.text IS NULL THEN NULL ELSE o.text END AS text,
    coalesce(o.n_deleted, 0) = 0 OR regexp_matches(o.text, '[^\x20\x09-\x0D]') AS kept
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""

_RUNS = """), copies AS (
    SELECT doc_id, i, j, row_number()"""
# Also the shortest run that ends at each line.
MAXIMAL_ORACLE = ORACLE.replace(
    _RUNS,
    """), all_runs AS (
    SELECT doc_id, i, l, j FROM runs WHERE j IS NOT NULL
    UNION
    SELECT a.doc_id, max(b.i) AS i, a.l, a.i AS j FROM counted a JOIN counted b
        ON b.doc_id = a.doc_id AND b.i <= a.i AND a.upto - b.upto + b.w >= 50
    GROUP BY a.doc_id, a.l, a.i
"""
    + _RUNS,
).replace("FROM runs WHERE j IS NOT NULL\n), marked", "FROM all_runs\n), marked")
