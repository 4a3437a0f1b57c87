"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct lower-cased words.  Tokens are ordered by rarity: by the
frequency class, over the lines of all documents, of the hash slot that a token falls into (a table
of fixed size), then by hash.  Two lines whose Jaccard similarity reaches 4/5 must share a token among
their first few (prefix filter); lengths, places in the prefix, and parity words of each set
(which bound the symmetric difference from below) discard most meetings right in the join.
What is left is verified on the full token sets, and lines that match an earlier line go.

Lines of equal token sets are one set with a first place before anything is joined, so a line
that a third of all documents share is one row there.  Each set first meets the HEADS earliest
sets of each of its first tokens alone; only sets that match none of them meet all earlier ones.
So members of a family of thousands of similar lines go after a few meetings each, and no match
is lost: the second time, all tokens of the prefix are used.

Defined edge cases: lines end at \\n; a line without words is kept and matches nothing; null or
empty text has no lines; order is (doc_id, line number); rows repeated with their doc_id have
the same places, so they neither match nor lose to each other; rows without a doc_id keep all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

#: Slots of the frequency table; classes are quarter powers of two.
SLOTS = 1 << 17
#: Sets of a prefix token that all others meet first.
HEADS = 4
#: Documents with lines to verify: up to so many places are broadcast, more are joined by a shuffle.
BROADCAST_DOCS = 500_000
#: The bits of a token's hash that it is ordered and met by.
_LOW = (1 << 31) - 1
#: Hashes hardly repeat, so looking for those that do costs more than it saves.
_PLAIN = {"parquet.enable.dictionary": "false"}
#: Sets of more tokens have a second parity word.
_WIDE = 48


def _clean(text: Column) -> Column:
    """Lower-cased text with its white space, but for line ends, as spaces."""
    low, odd = F.lower(text), F.lit(False)
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(low, "\t\x0b\f\r", "    ")).otherwise(low)


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc"), _clean(docs["text"].cast("string")).alias("text"))
    return rows.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc, line (from 0) and hashed tokens of each line that has words."""
    return _lines(docs).filter(F.col("words").rlike("[^ ]")).select("doc", "line", _hashes(F.col("words")).alias("tokens"))


def _hashed(docs: DataFrame) -> DataFrame:
    """row, doc, line, n, two hashes of the token set and 31 bits of each token's hash, of each line
    that has words.  Kept in the shared folder: texts are split and hashed once, to be counted and
    then ordered."""
    keyed = split_lines(docs).select("doc", "line", F.sort_array("tokens").alias("tokens"))
    low = F.transform("tokens", lambda t: t.bitwiseAND(F.lit(_LOW)).cast("int"))
    ids = [F.xxhash64("tokens").alias("set_a"), F.xxhash64(F.lit("b"), F.col("tokens")).alias("set_b")]
    return materialise(keyed.select(F.monotonically_increasing_id().alias("row"), "doc", "line", F.size("tokens").alias("n"), *ids, low.alias("low")), "linetokens", **_PLAIN)


def frequency_table(hashed: DataFrame) -> bytes:
    """The frequency class of each slot, one byte each; SLOTS rows reach the driver."""
    counts = hashed.select(F.explode("low").alias("token")).groupBy(_slot(F.col("token")).alias("slot")).count()
    table = bytearray(b"\x01" * SLOTS)
    for r in counts.collect():
        table[r["slot"]] = min(127, 1 + int(4 * math.log2(r["count"] + 1)))
    return bytes(table)


def _slot(token: Column) -> Column:
    return token.bitwiseAND(F.lit(SLOTS - 1))


def _ordered(table: bytes) -> Column:
    """Tokens as longs in order of rarity: class above, hash below."""
    classes = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    rank = lambda t: F.shiftleft(F.coalesce(classes[_slot(t)], F.lit(1).cast("long")), 32)
    return F.sort_array(F.transform("low", lambda t: rank(t).bitwiseOR(t.cast("long"))))


def _parity(half: bool) -> Column:
    """Oddly filled slots of 64, of all tokens or of the half whose bit 6 is set: the differing
    bits of two sets' words are at most the tokens that only one of them has."""
    one = F.lit(1).cast("long")
    mine = (lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)).cast("long")) if half else (lambda t: one)
    return F.aggregate("low", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", mine(t), t.bitwiseAND(F.lit(63)))))


def _place(doc: str, line: str) -> Column:
    """doc and line as one number of the same order."""
    return (F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(line).cast("decimal(10,0)")).cast("decimal(38,0)")


def _read(docs: DataFrame) -> DataFrame:
    """doc, line, n, place (the first one of its token set) of each line with words; and prefix,
    parity and parity_b of one line a set, null for others.  Kept in the shared folder."""
    hashed = _hashed(docs)
    keyed = hashed.withColumn("ordered", _ordered(frequency_table(hashed)))
    n = F.col("n")
    # 31 bits of a token are enough to meet by: what meets is verified on the words themselves
    prefix = F.transform(F.slice("ordered", F.lit(1), _first(n)), lambda t: t.bitwiseAND(F.lit(_LOW)).cast("int"))
    words = [_parity(False).alias("parity"), F.when(n > _WIDE, _parity(True)).otherwise(F.lit(0)).alias("parity_b")]
    full = materialise(keyed.select("row", "doc", "line", "n", prefix.alias("prefix"), *words, "set_a", "set_b"), "lines", **_PLAIN)
    release(hashed)
    place = _place("doc", "line")
    first = full.groupBy(F.col("set_a").alias("a"), F.col("set_b").alias("b")).agg(F.min(place).alias("place"), F.min_by("row", place).alias("first_row"))
    of = full.join(first, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")))
    lead = [F.when(F.col("row") == F.col("first_row"), F.col(c)).alias(c) for c in ("prefix", "parity", "parity_b")]
    sets = materialise(of.select("doc", "line", "n", "place", *lead), "linesets", **_PLAIN)
    release(full)
    return sets


def _short(n: Column) -> Column:
    """So many first tokens of n meet every set that is similar enough and of n tokens too."""
    return n - F.ceil(n * 8 / F.lit(9.0)).cast("int") + 1


def _first(n: Column) -> Column:
    """So many first tokens of n meet every set that is similar enough."""
    return n - F.ceil(n * 4 / F.lit(5.0)).cast("int") + 1


def _spread(sets: DataFrame, prefix: Column, still: Column) -> DataFrame:
    """A row for each token of each set's prefix.  shape holds the set's size, the token's place and
    whether the set is open: rows are narrow, and all of their columns are wanted of both sides of a
    join, so that the sides share one shuffle."""
    rows = sets.select("doc", "line", "parity", "parity_b", "n", still.cast("long").alias("open"), F.posexplode(prefix).alias("i", "token"))
    shape = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(F.col("open"))
    # never null by its form: Spark would test one side alone before the shuffle
    return rows.select("doc", "line", "parity", "parity_b", F.coalesce(shape, F.lit(0)).alias("shape"), "token")


def _size(side: str) -> Column:
    return F.shiftright(f"{side}_shape", 32)


def _behind(side: str) -> Column:
    """Tokens from the met one on."""
    return _size(side) - F.shiftright(F.col(f"{side}_shape").bitwiseAND(F.lit((1 << 32) - 1)), 1)


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Rows twice, with x and y in front of their columns; the least symmetric difference of two
    sets; and whether it and the places of the token leave them similar enough.

    For n tokens in all, a similarity of 4/5 is an overlap of 4n/9 and a symmetric difference of n/9.
    """
    x, y = (rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)) for side in "xy")
    c = F.col
    n = _size("x") + _size("y")
    a, b = c("x_parity").bitwiseXOR(c("y_parity")), c("x_parity_b").bitwiseXOR(c("y_parity_b"))
    apart = F.when(F.least(_size("x"), _size("y")) > _WIDE, F.bit_count(a.bitwiseXOR(b)) + F.bit_count(b)).otherwise(F.bit_count(a))
    places = (_behind("x") * 9 >= n * 4) & (_behind("y") * 9 >= n * 4)
    return x, y, apart, places & (apart * 9 <= n)


def _earlier() -> Column:
    return (F.col("x_doc") < F.col("y_doc")) | (F.col("x_doc") == F.col("y_doc")) & (F.col("x_line") < F.col("y_line"))


def _meet_heads(sets: DataFrame) -> DataFrame:
    """Pairs of one of the HEADS earliest sets with a token among the first and a later set."""
    x, y, apart, close = _named(_spread(sets, F.slice("prefix", F.lit(1), _short(F.col("n"))), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("x_token").orderBy("x_doc", "x_line"))
    # a difference: Spark would find a limit for each token in a plain comparison, sort for it before
    # the shuffle, and not share the shuffle with the other side
    heads = x.withColumn("rank", rank).filter(F.col("rank") - F.lit(HEADS) <= 0).drop("rank")
    return heads.join(y, (F.col("x_token") == F.col("y_token")) & _earlier() & close).select("x_doc", "x_line", "y_doc", "y_line", apart.alias("apart"))


def _meet_all(sets: DataFrame) -> DataFrame:
    """Pairs of an earlier set and a later open one that may be similar enough, by a token both have."""
    x, y, apart, close = _named(_spread(sets, F.col("prefix"), F.col("open")))
    # of both sides, if only in form: Spark would filter one side alone before the shuffle
    wanted = F.col("y_shape").bitwiseAND(F.lit(1)) > F.shiftrightunsigned("x_shape", 63)
    return x.join(y, (F.col("x_token") == F.col("y_token")) & wanted & _earlier() & close).select("x_doc", "x_line", "y_doc", "y_line", apart.alias("apart"))


def _settle(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """place of the later lines of pairs that match the earlier one."""
    pairs = materialise(pairs.distinct(), "linepairs")
    if pairs.isEmpty():
        return pairs.select(_place("y_doc", "y_line").alias("place"))
    some = materialise(_fetch(docs, pairs), "linetexts")
    # a line goes for one match, so its likeliest one is tried first, and all others where that fails
    first = pairs.groupBy("y_doc", "y_line").agg(F.min(F.struct("apart", "x_doc", "x_line")).alias("x"))
    sure = materialise(_verified(first.select("x.x_doc", "x.x_line", "y_doc", "y_line"), some), "lineshits")
    more = _verified(pairs.join(sure, ["y_doc", "y_line"], "left_anti"), some)
    gone = materialise(sure.union(more).distinct().select(_place("y_doc", "y_line").alias("place")), "linesgone")
    release(pairs, some, sure)
    return gone


def _fetch(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, line and token hashes of each line in a pair."""
    wanted = pairs.select(F.col("x_doc").alias("of"), F.col("x_line").alias("at")).union(pairs.select("y_doc", "y_line")).groupBy("of").agg(F.collect_set("at").alias("wanted"))
    if wanted.count() <= BROADCAST_DOCS:
        wanted = F.broadcast(wanted)
    some = docs.select(docs["doc_id"].cast("long").alias("doc"), docs["text"].cast("string").alias("text")).join(wanted, F.col("doc") == F.col("of"))
    some = some.select("doc", F.explode("wanted").alias("line"), F.split("text", "\n", -1).alias("all")).select("doc", "line", F.get("all", F.col("line")).alias("words"))
    return some.filter("words is not null").dropDuplicates(["doc", "line"]).select("doc", "line", _hashes(_clean(F.col("words"))).alias("tokens"))


def _verified(pairs: DataFrame, some: DataFrame) -> DataFrame:
    """y_doc and y_line of the later lines of pairs whose token sets are similar enough."""
    x, y = some.select(F.col("doc").alias("x_doc"), F.col("line").alias("x_line"), F.col("tokens").alias("s")), some.select(F.col("doc").alias("y_doc"), F.col("line").alias("y_line"), F.col("tokens").alias("t"))
    both = pairs.join(x, ["x_doc", "x_line"]).join(y, ["y_doc", "y_line"])
    return both.filter(F.size(F.array_intersect("s", "t")) * 9 >= (F.size("s") + F.size("t")) * 4).select("y_doc", "y_line").distinct()


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (doc, line, n) with their set's first place, and the places of the sets that match an
    earlier one."""
    lines = _read(docs)
    sets = lines.filter("prefix is not null and n is not null")
    gone = _settle(docs, _meet_heads(sets))
    out = gone.select(F.col("place").alias("gone"))
    left = sets.join(out, F.col("place") == F.col("gone"), "left").withColumn("open", F.col("gone").isNull())
    gone = materialise(gone.union(_settle(docs, _meet_all(left))), "linesgone")
    return lines.select("doc", "line", "n", "place"), gone


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, line, n_tokens, repeats (of an equal earlier line) and kept of each line with words."""
    lines, gone = matches(docs)
    again = F.col("place") != _place("doc", "line")
    marked = lines.join(gone.select(F.col("place").alias("gone")), F.col("place") == F.col("gone"), "left")
    return marked.select(F.col("doc").alias("doc_id"), "line", F.col("n").alias("n_tokens"), again.alias("repeats"), (~again & F.col("gone").isNull()).alias("kept"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs, all their columns, with the text of each row less the lines that match an earlier
    one.  Rows whose every line with words went are dropped; n_chars follows the text."""
    report = line_report(docs).filter(~F.col("kept"))
    gone = report.groupBy(F.col("doc_id").alias("gone_of")).agg(F.collect_set("line").alias("gone_lines"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = row.join(gone, F.col("row.doc_id") == F.col("gone_of"), "left")
    parts = F.split(F.col("row.text"), "\n", -1)
    kept = F.concat_ws("\n", F.filter(F.transform(parts, lambda v, i: F.when(~F.array_contains("gone_lines", i), v)), lambda v: v.isNotNull()))
    text = F.when(F.col("gone_lines").isNull(), F.col("row.text")).otherwise(kept)
    joined = joined.withColumn("new_text", text).filter(F.col("gone_lines").isNull() | (F.trim("new_text") != ""))
    out = [F.col("new_text").alias(c) if c == "text" else F.length("new_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    return joined.select(*out)


REPORT_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS words, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(lower(words), '[ \t\x0B\f\r]+'), lambda w: w <> ''))) AS tokens FROM l),
k AS (SELECT doc_id, line, tokens, len(tokens) AS n FROM t WHERE len(tokens) > 0),
s AS (SELECT tokens, any_value(n) AS n, min((doc_id, line)) AS place FROM k GROUP BY tokens),
w AS (SELECT place, n, unnest(tokens) AS token FROM s),
f AS (SELECT token, count(*) AS c FROM w GROUP BY token),
p AS (SELECT place, n, token FROM w JOIN f USING (token) QUALIFY row_number() OVER (PARTITION BY place ORDER BY c, token) <= n - ceil(0.8 * n) + 1),
m AS (SELECT DISTINCT x.place AS a, y.place AS b FROM p x JOIN p y ON x.token = y.token AND x.place < y.place AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
g AS (SELECT DISTINCT y.place FROM m JOIN s x ON a = x.place JOIN s y ON b = y.place
      WHERE 9 * len(list_intersect(x.tokens, y.tokens)) >= 4 * (x.n + y.n))
SELECT k.doc_id, k.line::INTEGER AS line, k.n::INTEGER AS n_tokens, (k.doc_id, k.line) <> s.place AS repeats,
       (k.doc_id, k.line) = s.place AND s.place NOT IN (SELECT place FROM g) AS kept
FROM k JOIN s ON k.tokens = s.tokens
"""
