"""Near-duplicate lines by MinHash over character shingles, with DataFrame functions alone."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, sided
from .graph import connected_components
from .rare import further_links

#: White space at a line's ends besides blanks.
OTHER_BLANKS = "\t\x0b\x0c\r"
#: Coordinates come in three groups of ``TURNS``; a band takes one of each group.
GROUPS, TURNS = 3, 5
#: Shingles that a row of the signature scan holds.
BLOCK = 16
COORDINATES = [f"m{i}" for i in range(GROUPS * TURNS)]
#: Numbers of 64 bits in a line's map of shingles.
WORDS = 32
MAP = [f"x{i}" for i in range(WORDS)]
#: Lines of a bucket that may meet two by two; lines of a larger one meet by their rarest shingles.
MEET = 128


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of ``docs(doc_id, text)``: lines without white space at their ends; blank ones are left out."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    cut = cut.withColumn("line", F.trim("line"))
    # Trimming a set of characters looks at every character of a line, so only lines that need it pay for it.
    ends = [test("line", F.lit(c)) for c in OTHER_BLANKS for test in (F.startswith, F.endswith)]
    odd = ends[0]
    for test in ends[1:]:
        odd = odd | test
    line = F.when(odd, F.btrim("line", F.lit(" " + OTHER_BLANKS))).otherwise(F.col("line"))
    return cut.select("doc_id", "line_no", line.alias("line")).filter("line <> ''")


def _keyed(lines: DataFrame) -> DataFrame:
    """A line's name is 96 bits of its hashes."""
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.hash("line")})


def bands(count: int) -> list[tuple[int, ...]]:
    """Which coordinate of each group a band takes: no two bands share more than one, so few coordinates serve many bands."""
    return [tuple((k + g * (k // TURNS)) % TURNS for g in range(GROUPS)) for k in range(count)]


def _constants(seed: int) -> list[list[int]]:
    """What the coordinates of each group are turned with; those of a group begin with different bits, so that few shingles decide two."""
    rng = random.Random(seed)
    return [[(begin << 29 | rng.getrandbits(29)) - (1 << 31) for begin in rng.sample(range(8), TURNS)] for _ in range(GROUPS)]


def _points(line: Column) -> Column:
    """Two bytes for each character (four for those beyond the basic plane), so that a shingle is cut out in constant time."""
    return F.encode(line, "UTF-16BE")


def _last(points: Column, width: int) -> Column:
    """Where the last shingle begins in the points, counted in bytes from 1."""
    return (F.greatest(F.octet_length(points) - 2 * width, F.lit(0)) + 1).cast("int")


def _shingles(line: Column, width: int) -> Column:
    """Hashes of the shingles of a line, repeats too; the list of one binds the points, which would else be made anew for each shingle."""
    def hashed(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), _last(p, width), F.lit(2)), lambda i: F.xxhash64(F.substring(p, i, F.lit(2 * width))))

    return F.transform(F.array(_points(line)), hashed)[0]


def _hashes(lines: DataFrame, key: list[str], width: int, block: int) -> DataFrame:
    """``lines(*key, line)`` as rows of ``block`` shingles' hashes, ``h0, h1, ...``, with ``last``, where the last shingle begins.

    The last one is repeated at a line's end, which changes no minimum and no map.
    """
    lines = lines.select(*key, _points(F.col("line")).alias("points"))
    lines = lines.select(*key, "points", _last(F.col("points"), width).alias("last"))
    blocks = lines.select(*key, "points", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * block))).alias("at"))
    return blocks.select(*key, "last", *[
        F.xxhash64(F.substring("points", F.expr(f"if(at + {2 * j} > last, last, at + {2 * j})"), F.lit(2 * width))).alias(f"h{j}") for j in range(block)])


def _signatures(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """``k1, k2`` and the coordinates of a signature over all shingles, for each different line.

    A shingle's hash is cut into three numbers of 32 bits, one for each group of coordinates.  A coordinate is the
    minimum after XOR with its constant, a permutation of these numbers.  A row of the scan holds several shingles:
    they share the look-up of their line.
    """
    hashed = _hashes(_keyed(lines_of(docs)), ["k1", "k2"], width, BLOCK)
    words = hashed.select("k1", "k2", *[
        F.shiftright(F.shiftleft(f"h{j}", 16 * g), 32).cast("int").alias(f"x{j}_{g}") for j in range(BLOCK) for g in range(GROUPS)])
    least = [
        F.min(F.least(*[F.col(f"x{j}_{g}").bitwiseXOR(F.lit(c)) for j in range(BLOCK)])).alias(COORDINATES[g * TURNS + turn])
        for g, group in enumerate(_constants(seed)) for turn, c in enumerate(group)]
    return words.groupBy("k1", "k2").agg(*least)


def _maps(texts: DataFrame, width: int) -> DataFrame:
    """``node, places, bits, x0, x1, ...`` of ``texts(node, line)``: a line's number of shingles, repeats counted, and which of 64 * WORDS bits they fall on."""
    hashed = _hashes(texts.repartition("node"), ["node"], width, 1)
    bits = hashed.select("node", "last", F.expr(f"cast(h0 & {WORDS - 1} as int)").alias("word"), F.expr("shiftleft(1L, cast(shiftright(h0, 16) & 63 as int))").alias("bit"))
    words = bits.groupBy("node", "word").agg(F.bit_or("bit").alias("bits"), F.max("last").alias("last"))
    found = words.groupBy("node").agg(((F.max("last") + 1) / 2).cast("int").alias("places"), *[F.expr(f"bit_or(if(word = {i}, bits, 0L))").alias(MAP[i]) for i in range(WORDS)])
    return found.select("node", "places", sum((F.bit_count(x) for x in MAP), F.lit(0)).alias("bits"), *MAP)


def _bucket_keys(count: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[COORDINATES[g * TURNS + turn] for g, turn in enumerate(band)]) for b, band in enumerate(bands(count))])


def _sketches(nodes: DataFrame, *more: str) -> DataFrame:
    """What :func:`_may_link` looks at.  Nothing of it is null; that Spark knows it keeps the code of a comparison short."""
    return nodes.select("node", *more, *[F.coalesce(F.col(k), F.lit(0).cast(nodes.schema[k].dataType)).alias(k) for k in ("places", "bits", *MAP)])


def _may_link(percent: int) -> Column:
    """Whether the maps of two lines allow a link.

    A bit that only one line's map has stands for a shingle, or more, that only this line has: the lines have at least
    bits + my_bits - 2 * both shingles apart, and at most the smaller places - bits, plus both, in common.  So no pair
    that reaches the similarity is ruled out.
    """
    both = sum((F.bit_count(F.col(x).bitwiseAND(F.col(f"my_{x}"))) for x in MAP), F.lit(0))
    more = F.least(F.col("places") - F.col("bits"), F.col("my_places") - F.col("my_bits"))
    return both * (100 + percent) >= (F.col("bits") + F.col("my_bits")) * percent - more * (100 - percent)


def _mine(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"my_{k}") for k in rows.columns])


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)``, a table that was written, of nodes whose full shingle sets reach the similarity."""
    left = texts.join(sided(pairs), F.expr("node = a")).select("a", "b", F.col("line").alias("left"))
    wanted = sided(pairs.select(F.col("b").alias("wanted")))
    right = texts.join(wanted, F.expr("node = wanted"), "left_semi").select(F.col("node").alias("b"), F.col("line").alias("right"))
    met = left.join(right.hint("merge"), "b")
    # A list of one pair of sets: exploded, each is made once.  Union and intersection leave repeats out.
    both = F.array(F.struct(_shingles(F.col("left"), width).alias("l"), _shingles(F.col("right"), width).alias("r")))
    met = met.select("a", "b", F.explode(both).alias("s"))
    met = met.select("a", "b", F.size(F.array_union("s.l", "s.r")).alias("union"), F.size(F.array_intersect("s.l", "s.r")).alias("shared"))
    return met.filter(F.col("shared") * 100 >= F.col("union") * percent).select("a", "b")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` of nodes that may be linked."""
    sketch = _sketches(nodes)
    met = _mine(sketch).join(sided(materialize(pairs)), F.expr("my_node = a")).join(sketch.hint("merge"), F.expr("b = node"))
    return materialize(met.filter(_may_link(percent)).select("a", "b"))


def _met(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``placed(bucket, node, part, home)`` that share a bucket and may be linked, of different parts, one at least outside its leader's."""
    rows = nodes.join(sided(materialize(placed.select("bucket", "node", "part", "home"))), "node")
    rows = _sketches(rows, "bucket", "part", "home")
    strays = _mine(rows.filter("part <> home"))
    # Two strays meet once; a stray meets all of the leader's component.
    once = F.expr("my_bucket = bucket and my_part <> part and (part = home or my_node < node)")
    met = strays.hint("merge").join(rows, once & _may_link(percent))
    return materialize(met.select(F.least("my_node", "node").alias("a"), F.greatest("my_node", "node").alias("b")).distinct())


def line_links(docs: DataFrame, width: int, percent: int, count: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences ``doc_id, line_no, k1, k2``, candidate lines ``node, k1, k2``, and the links ``a, b`` between nodes."""
    signed = materialize(_signatures(docs, width, seed))
    spread = signed.select("k1", F.explode(_bucket_keys(count)).alias("bucket"))
    shared = materialize(spread.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1"))
    held = materialize(spread.join(sided(shared), "bucket"))

    # One more scan of the texts names all lines and keeps the characters of those that share a bucket.
    wanted = materialize(held.select(F.col("k1").alias("wanted")).distinct())
    named = _keyed(lines_of(docs)).join(sided(wanted), F.expr("k1 = wanted"), "left")
    occurrences = materialize(named.select("doc_id", "line_no", "k1", "k2", F.when(F.col("wanted").isNotNull(), F.col("line")).alias("line")))
    texts = occurrences.filter("line is not null").groupBy("k1", "k2").agg(F.first("line").alias("line"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()))
    nodes = materialize(_maps(texts, width))

    # A bucket's leader is the line whose buckets hold most lines: of many variants, the least edited.
    held = held.join(texts.select("node", "k1").hint("merge"), "k1").select("bucket", "node", "held")
    weight = held.groupBy("node").agg(F.sum("held").alias("weight"))
    weighed = materialize(held.drop("held").join(weight.hint("merge"), "node"))
    first = weighed.groupBy("bucket").agg(F.max("weight").alias("weight"))
    first = weighed.join(first.hint("merge"), ["bucket", "weight"], "left_semi").groupBy("bucket").agg(F.min("node").alias("leader"))
    members = materialize(weighed.join(first.hint("merge"), "bucket"))
    pairs = _alike(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes, percent)
    links = materialize(_links(pairs, texts, width, percent))

    # Buckets whose lines are in several components: members outside the leader's may be linked with members of others.
    comps = connected_components(links.toDF("src", "dst"))
    part = comps.select(F.col("id").alias("node"), F.col("component").alias("part"))
    home = comps.select(F.col("id").alias("leader"), F.col("component").alias("home"))
    placed = members.filter("node <> leader").join(part.hint("merge"), "node", "left").join(home.hint("merge"), "leader", "left")
    placed = materialize(placed.select("bucket", "node", "weight", F.coalesce("part", "node").alias("part"), F.coalesce("home", "leader").alias("home")))
    crowded = placed.groupBy("bucket").agg(F.count_if(F.expr("part <> home")).alias("strays"), F.count("*").alias("n"))
    crowded = materialize(crowded.filter("strays > 0 and n > 1").select("bucket", "n"))
    small = placed.join(crowded.filter(F.col("n") <= MEET).hint("merge"), "bucket", "left_semi")
    links = links.unionByName(materialize(_links(_met(small, nodes, percent), texts, width, percent)))
    large = crowded.filter(F.col("n") > MEET)
    if large.limit(1).count():
        left_open = placed.join(large.hint("merge"), "bucket", "left_semi").groupBy("node").agg(F.first("weight").alias("weight"), F.first("part").alias("part"))
        left_open = materialize(left_open)
        sets = materialize(texts.join(left_open.hint("merge"), "node", "left_semi").select("node", F.array_distinct(_shingles(F.col("line"), width)).alias("shingles")))
        links = links.unionByName(further_links(left_open, sets, percent, links, lambda pairs: _links(pairs, texts, width, percent)))
    return occurrences.drop("line"), texts.select("node", "k1", "k2"), links


def fuzzy_lines(docs: DataFrame, width: int = 8, percent: int = 80, count: int = 10, seed: int = 11) -> DataFrame:
    """Keeps one line of each class of near-duplicate lines in ``docs(doc_id, text)``.

    Lines end at a line feed and lose white space at both ends.  A line's set is its different shingles of
    ``width`` characters (UTF-16 units); a shorter line is one shingle.  Equal lines are one node.  Every line is
    signed by all its shingles.  In each of its ``count`` buckets a line is compared with the bucket's leader.  Members outside the
    leader's component are then compared with the bucket's members of other components.  Maps of 64 * WORDS bits rule out pairs
    that can't be linked, and none that can.  Lines of buckets of more than ``MEET`` such members go to
    :func:`~pressgrid.llm.rare.further_links` instead, which finds the links among them by rare shingles, exactly.
    A link holds if 100 * shared >= percent * union on full sets; components are found by a
    distributed union-find.  With the defaults a pair of similarity 0.8 is met with a chance of about 0.995, one of
    0.9 with 0.9999.

    Returns ``doc_id, line_no, class_doc, class_line, kept`` for each line that isn't blank; a class is named by its
    first line in order of doc_id and line_no, which stays.  Null and blank texts have no lines.  Rows that
    repeat a doc_id and text repeat its lines, and a first line that repeats is kept each time.  A null doc_id
    comes after all others.  An empty table gives no rows.
    """
    occurrences, nodes, links = line_links(docs, width, percent, count, seed)
    classes = connected_components(links.toDF("src", "dst")).withColumnRenamed("id", "node")
    classes = materialize(nodes.join(classes.hint("merge"), "node").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component"))
    found = occurrences.join(sided(classes), F.expr("k1 = c1 and k2 = c2"), "left")
    grouped = F.col("component").isNotNull()
    named = found.select("doc_id", "line_no", F.coalesce("component", "k1").alias("class"), F.when(~grouped, F.col("k2")).alias("own"))
    place = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    firsts = named.groupBy("class", "own").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n").toDF("its_class", "its_own", "first")
    first = F.coalesce("first", place)
    return named.join(firsts.hint("merge"), F.expr("class = its_class and own <=> its_own"), "left").select(
        "doc_id", "line_no", first["d"].alias("class_doc"), first["l"].alias("class_line"),
        (first["d"].eqNullSafe(F.col("doc_id")) & (first["l"] == F.col("line_no"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines of ``decisions`` taken out of their texts; blank lines stay.

    Decisions are found by doc_id and line_no, null-safely.  Where several texts share an id, a line is taken out of a
    text only if no decision on that id and line number keeps it.  Null texts stay null.
    """
    marks = decisions.groupBy("doc_id", "line_no").agg(F.max("kept").alias("kept")).filter("not kept")
    dropped = marks.groupBy(F.col("doc_id").alias("its_doc")).agg(F.collect_set("line_no").alias("gone"))
    left = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains(F.col("s.gone"), i))
    text = F.when(F.col("s.gone").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    joined = docs.alias("d").join(dropped.alias("s").hint("merge"), F.expr("d.doc_id <=> s.its_doc"), "left")
    return joined.select(*[text.alias(k) if k == "text" else F.col(f"d.`{k}`") for k in docs.columns])
