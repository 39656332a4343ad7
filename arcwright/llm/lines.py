"""Line dedup by a segment-partition edit join, in DataFrame terms only.

A line is the sequence of its words, and an edit adds, drops or replaces one. How many edits two
lines may be apart grows with the shorter one's length (:data:`CLASSES`). Lines within ``t`` edits of
each other agree on one of ``t + 1`` even segments of the shorter one (Li et al., 2011). Every line
enters its segments' hashes by number and size; it probes the lengths ``l``, ``l - 1`` ... ``l - t``
with the runs of words that a matching segment can be, of which the position tells most apart.

Lines that meet on a key are a bucket. First each meets the bucket's commonest line only, and what
that does not link meets the others of the bucket; so many copies around one line make one link
each. A meeting is compared by length and by a bitmap of the words, then verified by Hyyrö's banded
bit-parallel recurrence, whose band of ``2 t + 1`` cells fits a long at any length of line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import WS, Shelf, text_or_empty
from arcwright.operators.components import connected_components
from arcwright.session import discard, materialize

#: From so many words on, so many edits; shorter lines are compared as they are only.
CLASSES = ((6, 1), (14, 2))
#: Keys, of eight bytes each, up to which those that lines share are broadcast; beyond, they are joined.
BROADCAST_KEYS = 1_000_000
#: The white space of :data:`arcwright.llm.text.WS`, as characters.
SPACES = " \t\n\x0b\x0c\r"
#: Words of 64 bits in a line's bitmap.
BITMAP = 4
#: What :func:`line_report` adds to the columns of a table.
REPORT = ("n_lines", "n_exact", "n_near", "n_kept", "component_id", "n_links")
#: Bytes of a word in what keys are made of.
MARK = 9
#: Spark's setting of the size of a generated method, in bytes of code, above which it splits it up.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def _pinned(column: Column) -> Column:
    """The same value, computed where it stands, so that a lambda does not compute it per element."""
    return F.when(F.spark_partition_id() >= 0, column)


def allowed(words: Column, classes: tuple = CLASSES) -> Column:
    """The edits that a line of so many words may have to a longer one."""
    out = F.lit(0)
    for least, edits in sorted(classes):
        out = F.when(words >= least, F.lit(edits)).otherwise(out)
    return out


def segment_bounds(n: Column, classes: tuple = CLASSES) -> dict[str, Column]:
    """What :func:`line_keys` reads by name, so that it is worked out once per line.

    ``t_<less>``: the edits that a line shorter by so many words may have; ``q_<edits>_<less>`` and
    ``r_<edits>_<less>``: the size of its segments, and how many, the last ones, have a word more.
    """
    most = max(t for _, t in classes)
    out = {f"t_{less}": allowed(n - less, classes) for less in range(most + 1)}
    for edits in sorted({t for _, t in classes}):
        for less in range(edits + 1):
            length = F.greatest(n - less, F.lit(0))
            out[f"r_{edits}_{less}"] = F.pmod(length, F.lit(edits + 1))
            out[f"q_{edits}_{less}"] = F.call_function("div", length, F.lit(edits + 1)).cast("int")
    return out


def spaced(line: Column) -> Column:
    """A trimmed line with one space between its words; only lines with other white space are searched by pattern."""
    odd = F.contains(line, F.lit("  "))
    for space in SPACES.replace(" ", ""):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.regexp_replace(line, f"[{WS}]+", " ")).otherwise(line)


def word_marks(line: Column) -> Column:
    """The words of a :func:`spaced` line as one binary string, :data:`MARK` bytes each: a run of words is a piece of it.

    A mark is the word's CRC-32 in hexadecimal, with a bit above it set, so that each has all its
    digits. Marks only lead to meetings; words decide.
    """
    digits = F.transform(F.split(line, " "), lambda w: F.hex(F.crc32(w).bitwiseOR(F.lit(1 << 32))))
    return F.array_join(digits, "").cast("binary")


def line_keys(marks: Column, classes: tuple = CLASSES) -> Column:
    """The hashes of the line's own segments, and of its probes for shorter lines, from :func:`word_marks`.

    A key holds the edits, the segment's number and its size, and the segment's words. It is odd, so
    that zero can stand for a probe that the length does not call for.
    """
    keys = []
    for edits in sorted({t for _, t in classes}):
        parts = edits + 1
        for less in range(parts):
            q, r = F.col(f"q_{edits}_{less}"), F.col(f"r_{edits}_{less}")
            for i in range(parts):
                size = F.when(r >= parts - i, q + 1).otherwise(q)
                start = q * i + F.greatest(r - (parts - i), F.lit(0))
                # How far a segment can have moved, seen from the left end and from the right.
                low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
                for shift in range(low, high + 1):
                    run = F.substring(marks, (start + shift) * MARK + 1, size * MARK)
                    key = F.xxhash64(F.lit(edits), F.lit(i), size, run).bitwiseOR(F.lit(1).cast("long"))
                    keys.append(F.when(F.col(f"t_{less}") == edits, key).otherwise(F.lit(0)))
    return F.array_distinct(F.array_remove(F.array(*keys), F.lit(0).cast("long")))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays if at most ``edits``; else something above it.

    Bit k of column j stands for row ``j - edits + k``. The score follows the band's lower edge
    until that reaches the last row, then the last row.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    m, n = F.size(a), F.size(b)

    def bit(x: Column, k: int) -> Column:
        return F.when(x, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, j: Column) -> Column:
        x = F.lit(0).cast("long")
        for k in range(width):
            row = j - edits + k  # 1-based
            x = x.bitwiseOR(bit((row >= 1) & (row <= m) & F.coalesce(F.get(a, row - 1) == F.get(b, j - 1), F.lit(False)), k))
        vp, vn = acc["vp"], acc["vn"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full)
        return finish(F.struct(vp.alias("vp"), vn.alias("vn"), acc["score"].alias("score"), d0.alias("d0")), j)

    def finish(s: Column, j: Column) -> Column:
        # A one-element transform names the value of d0, which the recurrence uses five times.
        def rest(t: Column) -> Column:
            d0, vp, vn = t["d0"], t["vp"], t["vn"]
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
            hn = d0.bitwiseAND(vp)
            moved = F.shiftright(d0, 1)
            at = m - j + edits  # the last row's bit, once inside the band
            diagonal = j <= m - edits
            row = F.greatest(at, F.lit(0))
            by = F.when(diagonal, 1 - F.getbit(d0, F.lit(2 * edits)).cast("int")).otherwise(
                F.getbit(hp, row).cast("int") - F.getbit(hn, row).cast("int")
            )
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"),
                moved.bitwiseAND(hp).alias("vn"),
                (t["score"] + by).alias("score"),
            )

        return F.get(F.transform(F.array(s), rest), F.lit(0))

    start = F.struct(
        F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"),
        F.lit(0).cast("long").alias("vn"),
        F.least(m, F.lit(edits)).alias("score"),
    )
    columns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # Along the band's edge the score never falls, and the at most 2 t steps along the last row take
    # one off each: beyond 3 t it cannot come back to t.
    return F.aggregate(
        columns,
        start,
        lambda acc, j: F.when(acc["score"] > 3 * edits, acc).otherwise(step(acc, j)),
        lambda acc: acc["score"],
    )


def _parted(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the arrays ``a`` and ``b`` from the first element on in which they differ, last element first."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    beyond = F.greatest(F.size(a), F.size(b)) + 1
    found = pairs.withColumn("_at", _pinned(F.when(differ > 0, differ.cast("int")).otherwise(beyond)))
    cut = {name: _pinned(F.reverse(F.slice(name, F.col("_at"), F.greatest(F.size(name), F.lit(1))))) for name in (a, b)}
    return found.withColumns(cut).drop("_at")


def within_edits(pairs: DataFrame, a: str, b: str, edits: Column | int, most: int) -> DataFrame:
    """The rows of ``pairs`` whose arrays ``a`` and ``b`` are at most ``edits`` (``most`` at most) edits apart.

    What both begin and end with changes no distance and is left out first; the arrays do not come back whole.
    """
    pairs = pairs.withColumn("_edits", _pinned(F.lit(edits) if isinstance(edits, int) else edits))
    pairs = _parted(_parted(pairs.filter(F.abs(F.size(a) - F.size(b)) <= F.col("_edits")), a, b), a, b)
    return pairs.withColumn("_d", _pinned(banded_distance(F.col(a), F.col(b), most))).filter(F.col("_d") <= F.col("_edits")).drop("_d", "_edits")


def _split_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(doc, pos, line, lid, hid)`` of the lines with other than white space, trimmed; two hashes are a line's identity."""
    parts = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(text_or_empty(text), "\n")).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(SPACES))
    lines = parts.select("doc", "pos", line.alias("line")).filter(F.col("line") != "")
    return lines.withColumns({"lid": F.xxhash64("line"), "hid": F.xxhash64(F.lit(1), "line")})


def _keyed_lines(lines: DataFrame, classes: tuple = CLASSES) -> DataFrame:
    """Lines with their number of words ``n`` and keys ``ks``, written; the text and the keys only where an edit is allowed.

    All keys in one generated method are more than the virtual machine compiles, so the limit above
    which Spark generates smaller ones is set to what it does compile, for this write.
    """
    spark = lines.sparkSession
    one = lines.select("doc", "pos", "lid", "hid", _pinned(spaced(F.col("line"))).alias("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    sized = one.withColumn("n", _pinned(n))
    some = F.col("n") >= min(least for least, _ in classes)
    marked = sized.select("doc", "pos", "lid", "hid", "n", _pinned(F.when(some, F.col("line"))).alias("line"))
    marked = marked.withColumn("marks", _pinned(word_marks(F.col("line"))))
    bounded = marked.select("*", *[_pinned(c).alias(name) for name, c in segment_bounds(F.col("n"), classes).items()])
    keyed = bounded.select("doc", "pos", "lid", "hid", "n", "line", _pinned(line_keys(F.col("marks"), classes)).alias("ks"))
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, "8000")
    try:
        return materialize(keyed, "line-keyed")
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT)
        else:
            spark.conf.set(METHOD_LIMIT, before)


def _alike(a: str, b: str, classes: tuple) -> Column:
    """What lengths and bitmaps of two lines allow: an edit sets one bit and clears one, at most."""
    edits = allowed(F.least(f"{a}.n", f"{b}.n"), classes)
    apart = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(BITMAP)), F.lit(0))
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= edits) & (apart <= 2 * edits)


def similar_lines(keyed: DataFrame, classes: tuple = CLASSES) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` that span the classes of lines within the allowed edits, and ``(lid, hid)`` of the lines that met.

    ``keyed`` is a table of :func:`_keyed_lines`, read twice. Keys are counted first, by
    themselves: a partial aggregate leaves one row per key and task, however often a line is repeated.
    Only lines that share a key with another line then come back with their text, and only their
    words are hashed; as many lines share none, these are few.
    """
    most = max(t for _, t in classes)
    met = (
        keyed.select("lid", F.explode("ks").alias("key"))
        .groupBy("key")
        .agg(F.min("lid").alias("low"), F.max("lid").alias("high"))
        .filter("low <> high")
        .select("key")
    )
    met = materialize(met, "line-keys")
    few = met.count() <= BROADCAST_KEYS
    members = keyed.select("lid", "hid", "line", "n", F.explode("ks").alias("key")).join(F.broadcast(met) if few else met, "key")
    members = members.groupBy("lid").agg(
        F.first("hid").alias("hid"), F.first("line").alias("line"), F.first("n").alias("n"),
        F.collect_set("key").alias("keys"), (-F.count("*")).alias("rare"),
    )
    words = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    members = members.select("lid", "hid", _pinned(words).alias("words"), "n", "keys", "rare")

    def bitmap(k: int) -> Column:
        def one(acc: Column, w: Column) -> Column:
            mine = F.shiftright(w, 6).bitwiseAND(F.lit(BITMAP - 1)) == k
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
            return F.when(mine, acc.bitwiseOR(bit)).otherwise(acc)

        return F.aggregate("words", F.lit(0).cast("long"), one)

    members = materialize(members.select("*", *[bitmap(k).alias(f"b{k}") for k in range(BITMAP)]), "line-members")
    brief = members.select("lid", F.struct("n", *[f"b{k}" for k in range(BITMAP)]).alias("p"))

    def verified(pairs: DataFrame) -> DataFrame:
        words = members.select("lid", "words")
        joined = pairs.join(words.toDF("a", "_wa"), "a").join(words.toDF("b", "_wb"), "b")
        edits = allowed(F.least(F.size("_wa"), F.size("_wb")), classes)
        return within_edits(joined, "_wa", "_wb", edits, most).select("a", "b")

    narrow = members.select("lid", "rare", F.explode("keys").alias("key"))
    # The commonest line of a bucket is its centre: what was changed differs least from it.
    centres = narrow.groupBy("key").agg(F.min(F.struct("rare", "lid")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    bucket = narrow.join(centres.select("key", F.col("c.lid").alias("centre")), "key").filter("lid <> centre")
    bucket = materialize(bucket.select("key", "lid", "centre").join(brief, "lid"), "line-buckets")
    star = bucket.join(brief.toDF("centre", "c"), "centre").filter(_alike("p", "c", classes))
    first = materialize(verified(star.select(F.col("lid").alias("a"), F.col("centre").alias("b")).distinct()), "line-stars")
    # What is not yet of its bucket's centre's class meets the others of the bucket that are not of its own.
    so_far = materialize(connected_components(first, finish_rows=0), "line-so-far")
    bucket = bucket.join(so_far.toDF("lid", "g"), "lid", "left").withColumn("g", F.coalesce("g", "lid"))
    bucket = bucket.join(so_far.toDF("centre", "cg"), "centre", "left").withColumn("cg", F.coalesce("cg", "centre"))
    bucket = materialize(bucket.select("key", "lid", "p", "g", "cg"), "line-grouped")
    others = bucket.select("key", F.col("lid").alias("other"), F.col("p").alias("q"), F.col("g").alias("h"))
    rest = bucket.filter("g <> cg").join(others, "key").filter((F.col("g") != F.col("h")) & _alike("p", "q", classes))
    rest = rest.select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b")).distinct()
    rest = materialize(rest, "line-pairs")
    return first.union(verified(rest)), members.select("lid", "hid")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", classes: tuple = CLASSES) -> DataFrame:
    """``(doc, pos, lid, class, near, kept, owner)`` of every line that is not blank.

    Lines are trimmed. Equal lines are one class, and lines within the edits that ``classes`` allow
    are linked; classes are components of the links. Of a class, the line of the smallest document
    stays, there the first; ``near`` tells whether it stays in other words, and ``owner`` is the smallest
    document with a line of the class, null ids aside. Blank lines belong to no class. A null text has no lines. Rows that repeat a document repeat its places: a place stays or
    goes in all of them. A null id is the smallest. A line of any length is compared whole. An empty
    table gives an empty result. Other columns are left out, so their names cannot clash.
    """
    lines = _keyed_lines(_split_lines(docs, id_col, text), classes)
    links, met = similar_lines(lines, classes)
    found = connected_components(materialize(links, "line-links"), finish_rows=0)
    # By both hashes: another line with the first hash of a linked one has its own class.
    linked = met.join(found, F.col("lid") == F.col("node")).select("lid", "hid", "component")
    narrow = lines.select("doc", "pos", "lid", "hid").join(linked, ["lid", "hid"], "left")
    narrow = narrow.select(
        "doc", "pos", "lid", F.coalesce("component", "lid").alias("class"),
        F.when(F.col("component").isNull(), F.col("hid")).otherwise(F.lit(0)).alias("own"),
    )
    narrow = materialize(narrow, "line-places")
    discard(lines)
    first = narrow.groupBy("class", "own").agg(
        F.min(F.struct("doc", "pos", "lid")).alias("f"), F.min("doc").alias("owner"), F.count("*").alias("n")
    )
    # Only classes with more than one line decide anything.
    several = materialize(first.filter("n > 1"), "line-firsts")
    return narrow.join(several, ["class", "own"], "left").select(
        "doc",
        "pos",
        "lid",
        "class",
        F.coalesce(F.col("f.lid") != F.col("lid"), F.lit(False)).alias("near"),
        (F.col("f").isNull() | (F.col("f.doc").eqNullSafe(F.col("doc")) & (F.col("f.pos") == F.col("pos")))).alias("kept"),
        F.coalesce("owner", "doc").alias("owner"),
    )


def _without(joined: DataFrame, text: str, columns: list) -> DataFrame:
    """``columns`` of ``joined`` with the lines at the places ``_gone`` taken out of ``text``; null or no places leave it."""
    cut = joined.withColumn("_parts", _pinned(F.when(F.size("_gone") > 0, F.split(F.col(text), "\n"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    left = F.array_join(F.transform(stay, lambda p: F.get("_parts", p)), "\n")
    return cut.withColumn(text, F.when(F.col("_parts").isNull(), F.col(text)).otherwise(left)).select(*columns)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that do not stay taken out of the text; blank lines stay.

    Columns keep their names and order. A null text stays null.
    """
    shelf = Shelf(docs)
    ident, whole = shelf.of(id_col), shelf.of(text)
    gone = line_classes(shelf.table, ident, whole, **options).filter("NOT kept").groupBy("doc").agg(F.collect_set("pos").alias("_gone"))
    joined = shelf.table.join(gone, F.col(ident).cast("long").eqNullSafe(F.col("doc")), "left")
    return shelf.back(_without(joined, whole, shelf.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` as :func:`line_dedup` returns them, with the columns :data:`REPORT`.

    Of the document's lines, ``n_lines`` are not blank, ``n_exact`` go as copies, ``n_near`` go as near
    copies and ``n_kept`` stay. ``n_links`` counts the other documents that own a class of its lines;
    ``component_id`` is the smallest document reachable by such links, itself included. A null id has no
    links. A column of ``docs`` that clashes with a result column gives way to it.
    """
    shelf = Shelf(docs, REPORT)
    ident, whole = shelf.of(id_col), shelf.of(text)
    per_doc = line_classes(shelf.table, ident, whole, **options).groupBy("doc").agg(
        F.count("*").alias("n_lines"),
        F.count_if(~F.col("kept") & ~F.col("near")).alias("n_exact"),
        F.count_if(~F.col("kept") & F.col("near")).alias("n_near"),
        F.count_if("kept").alias("n_kept"),
        F.collect_set(F.when(~F.col("kept"), F.col("pos"))).alias("_gone"),
        F.collect_set(F.when(F.col("owner") != F.col("doc"), F.col("owner"))).alias("_owners"),
    )
    per_doc = materialize(per_doc, "line-documents")
    found = connected_components(per_doc.select(F.col("doc").alias("a"), F.explode("_owners").alias("b")), finish_rows=0)
    per_doc = per_doc.join(found, F.col("doc") == F.col("node"), "left")
    joined = shelf.table.join(per_doc, F.col(ident).cast("long").eqNullSafe(F.col("doc")), "left")
    zero = F.lit(0).cast("long")
    made = [
        *[F.coalesce(c, zero).alias(c) for c in REPORT[:4]],
        F.coalesce("component", F.col(ident).cast("long")).alias("component_id"),
        F.when(F.size("_owners") > 0, F.size("_owners").cast("long")).otherwise(zero).alias("n_links"),
    ]
    return shelf.back(_without(joined, whole, [*shelf.columns, *made]))


def line_query(spark, sf_dir):
    """Per document: what :func:`line_report` says of it, and the SHA-256 of the text with its lines taken out."""
    report = line_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return report.select("doc_id", *REPORT, F.sha2(text_or_empty("text"), 256).alias("text_sha256"))
