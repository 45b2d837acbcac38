"""Line deduplication across a corpus, up to one edit, in DataFrame functions only.

A line is dropped when an earlier line of the corpus is equal to it or, from 20 characters on,
one edit away; in shorter lines an edit makes another line. Pairs one
edit apart are found by a segment-partition join: a line is split into threshold + 1 = 2
segments, of which one edit leaves one whole. The segments index a line by its length; a line
probes the index of its own length and of the next shorter one with the substrings that the
other's segments would have there. What an index entry does not fix of a line, its rest, is one
edit from the others' rests in turn, so an entry of many lines is split by the segments of the
rests, again and again, until few lines or one character are left. Candidates are verified by a
banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import matching, persist_plan, unused

MAX_EDITS = 1
#: Shorter lines (after trimming) are dropped only if equal to an earlier one.
MIN_CHARS = 20
#: Lines of an index entry that are paired; an entry of more is split by the segments of the rests,
#: of which there are so many.
PAIRED = 32
PARTS = 4
#: Pairs that one task compares, about.
PAIRS_A_TASK = 512


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, th, pos, n): document, hash of its text, line number and normal form of lines that aren't blank."""
    parts = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return parts.select("d", "th", "pos", normal(F.col("line")).alias("n")).filter("n <> ''")


def segment_keys(n: Column) -> list[Column]:
    """The line's own two index keys, and the two it probes the next shorter length with; nulls for a short line."""
    size, out = F.length(n), []
    for shorter in (0, 1):
        length = size - shorter
        half = F.floor(length / 2).cast("int")
        out.append(F.xxhash64(F.lit(1), length, F.left(n, half)))
        out.append(F.xxhash64(F.lit(2), length, F.right(n, length - half)))
    return [F.when(size >= MIN_CHARS, key) for key in out]


def with_edit_distance(df: DataFrame, a: Column, b: Column, k: int, out: str) -> DataFrame:
    """``df`` with the edit distance of two strings, or some number above k if it is above k.

    Column j of the matrix is held by the rows j - k to j + k, one bit each, as vertical
    differences; the band moves down with j. The distance is followed along the lowest diagonal,
    and along the last row once the diagonal has met it. The characters stay in columns of their
    own beside the fold, whose state is three integers.
    """
    mask = (1 << (2 * k + 1)) - 1
    m, n = F.length(a), F.length(b)
    split = df.select("*", F.split(a, "").alias("_x"), F.split(b, "").alias("_y"), m.alias("_m"))

    def flip(c: Column) -> Column:
        return c.bitwiseXOR(F.lit(mask))

    def bind(value: Column, use) -> Column:
        """Evaluates a value once for all its uses: transform over an array of one."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def step(s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]

        def matches(c: Column) -> Column:
            eq = F.lit(0)
            for t in range(2 * k + 1):
                eq = eq + F.when(F.get("_x", j + (t - k - 1)) == c, F.lit(1 << t)).otherwise(F.lit(0))
            return eq

        def diagonal(e: Column) -> Column:
            return ((e.bitwiseAND(vp) + vp).bitwiseAND(F.lit(mask))).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn)

        def finish(d0: Column) -> Column:
            hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            bit = F.element_at(F.array(*[F.lit(1 << t) for t in range(2 * k + 1)]), F.greatest(F.col("_m") - j + k, F.lit(0)) + 1)
            on_row = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            on_diagonal = F.when(d0.bitwiseAND(F.lit(1 << (2 * k))) != 0, 0).otherwise(1)
            dist = s["d"] + F.when(j + k <= F.col("_m"), on_diagonal).otherwise(on_row)
            return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), dist.cast("int").alias("d"))

        return bind(bind(matches(F.get("_y", j - 1)), diagonal), finish)

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    distance = F.when(F.abs(m - n) > k, F.lit(k + 1)).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"]))
    return split.withColumn(out, distance).drop("_x", "_y", "_m")


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` of keys that a line and another line have, with the lines of the key in ``size``.

    The lines of a key are counted before they are shuffled, and never sorted or gathered.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(~F.col("probe")).alias("own"))
    return rows.join(sizes.filter("size > 1 and own > 0").drop("own"), "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """(h1, h2, g1, g2): two lines that one key may join. ``rows`` hold few lines of each key."""
    a = rows.filter("not probe").select("key", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    b = rows.select("key", "h1", "h2", "probe")
    return b.join(a, "key").filter("probe or (h1, h2) > (g1, g2)").filter("h1 <> g1 or h2 <> g2").select("h1", "h2", "g1", "g2")


def _split(rows: DataFrame) -> DataFrame:
    """Rows (key, h1, h2, probe, rest) by PARTS parts of the rest: each part in turn is left out
    and stays the rest, and what stands around it joins the key. The rest of a probing line is
    one character longer, wherever that is."""
    extra = F.col("probe").cast("int")
    size = F.length("rest") - extra
    parts = []
    for t in range(PARTS):
        low, high = F.floor(size * t / PARTS).cast("int"), F.floor(size * (t + 1) / PARTS).cast("int")
        before, behind = F.left("rest", low), F.right("rest", size - high)
        parts.append(F.struct(F.xxhash64("key", F.lit(t), before, F.lit("|"), behind).alias("key"), F.substr(F.col("rest"), low + 1, high - low + extra).alias("rest")))
    return rows.select("h1", "h2", "probe", F.explode(F.array(*parts)).alias("p")).select("p.key", "h1", "h2", "probe", "p.rest")


def _stars(rows: DataFrame) -> DataFrame:
    """(h1, h2, g1, g2) of lines that agree but for a rest of at most one character.

    All lines of a key are one edit apart: each is paired with the earliest. A probing line has
    one character more than the line whose rest it has without it.
    """
    clique = rows.filter("not probe").groupBy("key").agg(F.min(F.struct("place", "h1", "h2")).alias("c"))
    own = rows.filter("not probe").join(clique, "key").select("h1", "h2", F.col("c.h1").alias("g1"), F.col("c.h2").alias("g2"))
    longer = rows.filter("probe").select("key", "h1", "h2", F.explode(F.array_distinct(F.array(F.substr(F.col("rest"), F.lit(2)), F.left("rest", F.length("rest") - 1)))).alias("rest"))
    shorter = rows.filter("not probe").select("key", "rest", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    return own.filter("h1 <> g1 or h2 <> g2").union(longer.join(shorter, ["key", "rest"]).select("h1", "h2", "g1", "g2"))


def near_links(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2, g1, g2): hashes of a line and of an earlier line one edit away.

    Every line of 20 characters has at least one earlier such line here if it has any one edit away. The lines of an
    index entry are paired where they are few; an entry of many is split by parts of the rests,
    which get shorter from round to round: all rounds together shuffle a line's characters as
    often as it has such entries in a round, at most once for each halving of its length. Where
    one character is left, each line is paired with one other.
    """
    keyed = distinct.select("h1", "h2", F.posexplode(F.array("k1", "k2", "p1", "p2")).alias("i", "key")).select("h1", "h2", "key", "i", (F.col("i") >= 2).alias("probe")).filter("key is not null")
    shared = persist_plan(_shared(keyed))
    met = shared.select("h1", "h2").distinct()
    place = F.xxhash64("d", "th", "pos").alias("at")  # null ids are places too
    ids = persist_plan(distinct.select("h1", "h2", place).join(met, ["h1", "h2"], "left_semi"))
    # by line and place, so that the many rows of a common line don't meet
    texts = matching(lines.select("d", "th", "pos", "n", *_hashes(), place), ids, ["h1", "h2", "at"]).groupBy("h1", "h2").agg(F.min(F.struct("d", "th", "pos", "n")).alias("r"))
    texts = persist_plan(texts)
    found = [_pairs(shared.filter(F.col("size") <= PAIRED))]
    crowd = shared.filter(F.col("size") > PAIRED)
    if not crowd.isEmpty():
        n, first = F.col("r.n"), F.col("i") % 2 == 0  # the left segment is shared, else the right one
        extra = F.col("probe").cast("int")
        half = F.floor((F.length(n) - extra) / 2).cast("int")
        rest = F.when(first, F.substr(n, half + 1)).otherwise(F.left(n, half + extra))
        crowd = crowd.join(texts, ["h1", "h2"]).select("key", "h1", "h2", "probe", rest.alias("rest"))
        while True:
            level = persist_plan(_shared(_split(crowd)))
            few = F.col("size") <= PAIRED
            last = F.length("rest") - F.col("probe").cast("int") <= 1
            found.append(_pairs(level.filter(few)))
            ends = level.filter(~few & last).join(texts.select("h1", "h2", F.struct("r.d", "r.th", "r.pos").alias("place")), ["h1", "h2"])
            found.append(_stars(ends))
            crowd = level.filter(~few & ~last).select("key", "h1", "h2", "probe", "rest")
            if crowd.isEmpty():
                break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.distinct()
    both = pairs.join(texts.withColumnRenamed("r", "ra"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("r").alias("rb")), ["g1", "g2"])
    both = persist_plan(both)
    # adaptive execution goes by bytes; what weighs here is the comparing
    both = both.repartition(min(10_000, -(-both.count() // PAIRS_A_TASK) or 1))
    scored = with_edit_distance(both, F.col("ra.n"), F.col("rb.n"), MAX_EDITS, "edits")
    # written out before it is filtered: a filter would be pushed below the split characters
    near = persist_plan(scored.select("h1", "h2", "g1", "g2", (F.col("ra") > F.col("rb")).alias("later"), "edits")).filter(F.col("edits") <= MAX_EDITS)
    later = F.col("later")
    return near.select(*[F.when(later, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("h1", "g1"), ("h2", "g2"))]).distinct()


def _hashes() -> tuple[Column, Column]:
    """Two independent 64-bit hashes name a line."""
    return F.xxhash64("n").alias("h1"), F.xxhash64(F.lit(0x5BD1E995), "n").alias("h2")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` cut down to first lines, and n_lines and n_dropped added.

    Lines are compared trimmed and in lower case; the order is that of the ids (null first), then
    of the text's hash, then of the lines. Lines of under 20 characters go only if equal to an
    earlier line, and blank ones stay: they part paragraphs. Null texts stay
    null and empty ones empty, with 0 and 1 lines; a text of which nothing is left becomes
    empty; rows alike in id and text are one document and get the same result; columns named
    n_lines or n_dropped are replaced; an empty table gives an empty one.
    """
    lines = lines_of(docs, doc_id, text)
    k1, k2, p1, p2 = segment_keys(F.col("n"))
    keyed = lines.select("d", "th", "pos", *_hashes(), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))
    # the keys follow from the line, so grouping by them too only carries them along
    distinct = keyed.groupBy("h1", "h2", "k1", "k2", "p1", "p2").agg(F.min(F.struct("d", "th", "pos")).alias("first"))
    distinct = persist_plan(distinct.select("h1", "h2", "k1", "k2", "p1", "p2", "first.d", "first.th", "first.pos"))
    near = near_links(lines, distinct)
    kept = distinct.select("h1", "h2", "d", "th", "pos").join(near, ["h1", "h2"], "left_anti")
    kept = kept.groupBy("d", "th").agg(F.collect_list("pos").alias("_kept"))
    key, body, parts, kept_at, stay_at = unused(docs, "_id", "_th", "_lines", "_kept", "_stay")
    # a null id meets no other through =, so the key says which it is
    keyed_docs = docs.select("*", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias(key), F.xxhash64(text).alias(body))
    kept = kept.select(F.coalesce(F.col("d").cast("string"), F.lit("null")).alias(key), F.col("th").alias(body), F.col("_kept").alias(kept_at))
    joined = keyed_docs.join(kept, [key, body], "left").withColumn(parts, F.split(F.col(text), "\n", -1))
    everything = F.sequence(F.lit(0), F.size(parts) - 1)
    blank = F.filter(everything, lambda i: normal(F.get(parts, i)) == "")
    stay = F.array_sort(F.array_union(blank, F.coalesce(kept_at, F.array().cast("array<int>"))))
    joined = joined.withColumn(stay_at, F.when(F.col(text).isNotNull(), stay))
    n_lines = F.when(F.col(text).isNotNull(), F.size(parts)).otherwise(0)
    cut = F.struct(
        F.array_join(F.transform(stay_at, lambda i: F.get(parts, i)), "\n").alias("text"),
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.coalesce(F.size(stay_at), F.lit(0))).cast("long").alias("n_dropped"),
    )
    # exploded, so that what reads the text several times, filters too, doesn't cut it again each time
    (cut_at,) = unused(joined, "_cut")
    out = joined.select("*", F.explode(F.array(cut)).alias(cut_at))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    columns = [F.col(f"{cut_at}.text").alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in names]
    return out.select(*columns, f"{cut_at}.n_lines", f"{cut_at}.n_dropped")
