"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text.

A section ends after an empty line, a paragraph after a line break, a piece after a word that ends in one of a fixed set
of characters, or after 64 characters; boundaries depend on nearby text only, so an edit leaves the pieces elsewhere as
they were. The first 32 characters of a text are cut finer, after vowels and spaces, so that the shortest texts have
several pieces too. Pieces are hashed with SHA-256; a paragraph's hash is that of its pieces' hashes, a section's that of its
paragraphs', the root's that of its sections'. Separators belong to the pieces, so texts are equal if their roots are.

A fingerprint is the root in hex, a colon, and six hex digits of each piece. The likeness of two fingerprints is 1 if
their roots are equal, else twice the number of distinct pieces they share by the number both have. Where two trees
differ, differing_paragraphs() follows the branches that differ down to the edited paragraphs; with_first_difference()
follows the first one within a row.

Everything is a DataFrame expression. Null counts as the empty text, which has no pieces. Each row is worked on by
itself, except for the next document, which is found among the 256 neighbouring ids, or is the first row of a later
group of them. Repeated ids are ordered by text, rows that also repeat that are alike. Rows without a doc_id have no next
document, only a fingerprint and a length. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import common

PIECE = r"(?s)[^\n]{0,63}?(?:[es\p{P}][ \t]+|\n)|[^\n]{1,64}"
#: The first so many characters of a text, and their pieces.
FINE_CHARS = 32
FINE = r"(?s)[^\n]{0,3}?(?:[aeiou\p{P} \t]|\n)|[^\n]{1,4}"
DIGITS = 6
#: Bits of a doc_id that rows of one group of neighbours may differ in, and of the groups on the levels above.
NEAR_BITS, LEVEL_BITS = 8, 12


def _hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _parts(x: Column, pattern: str) -> Column:
    return F.filter(F.split(x, pattern, -1), lambda p: p != "")


def with_tree(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: struct(root, sections), where a section is (hash, paragraphs) and a paragraph (hash, n_chars, pieces)."""
    cut = lambda p, pattern: F.regexp_extract_all(p, F.lit(pattern), F.lit(0))
    first = lambda p: F.concat(cut(F.left(p, F.lit(FINE_CHARS)), FINE), cut(F.substring(p, FINE_CHARS + 1, 1 << 30), PIECE))
    pieces = lambda p, at_start: F.transform(F.when(at_start, first(p)).otherwise(cut(p, PIECE)), _hash)
    joined = lambda xs, f: _hash(F.array_join(F.transform(xs, f), ""))
    return (
        docs.withColumn(
            "_pieces",
            F.transform(
                _parts(common.text_or_empty(text), r"(?<=\n\n)"),
                lambda s, i: F.transform(_parts(s, r"(?<=\n)"), lambda p, j: F.struct(F.char_length(p).alias("n_chars"), pieces(p, i + j == 0).alias("pieces"))),
            ),
        )
        .withColumn(
            "_paragraphs",
            F.transform("_pieces", lambda s: F.transform(s, lambda p: F.struct(_hash(F.array_join(p["pieces"], "")).alias("hash"), p["n_chars"].alias("n_chars"), p["pieces"].alias("pieces")))),
        )
        .withColumn("_sections", F.transform("_paragraphs", lambda s: F.struct(joined(s, lambda p: p["hash"]).alias("hash"), s.alias("paragraphs"))))
        .withColumn(out, F.struct(joined(F.col("_sections"), lambda s: s["hash"]).alias("root"), F.col("_sections").alias("sections")))
        .drop("_pieces", "_paragraphs", "_sections")
    )


def fingerprint(tree: str | Column) -> Column:
    """A tree as a string."""
    t = F.col(tree) if isinstance(tree, str) else tree
    of_section = lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.array_join(F.transform(p["pieces"], lambda h: F.left(h, F.lit(DIGITS))), "")), "")
    return F.concat(t["root"], F.lit(":"), F.array_join(F.transform(t["sections"], of_section), ""))


def branches(tree: str) -> Column:
    """The hashes of a tree's sections and paragraphs, 16 digits of each, and the paragraphs' lengths: no pieces."""
    short = lambda x: F.left(x["hash"], F.lit(16)).alias("hash")
    return F.transform(F.col(tree)["sections"], lambda s: F.struct(short(s), F.transform(s["paragraphs"], lambda p: F.struct(short(p), p["n_chars"].alias("n_chars"))).alias("paragraphs")))


def with_likeness(df: DataFrame, one: str, other: str, out: str) -> DataFrame:
    """Add `out`, the likeness of two fingerprint columns, 0 to 1; null where one is null."""
    pieces = lambda c: F.array_distinct(F.regexp_extract_all(F.substring_index(c, ":", -1), F.lit(f".{{{DIGITS}}}"), F.lit(0)))
    both = F.size("_one") + F.size("_other")
    return (
        df.withColumn("_one", pieces(one))
        .withColumn("_other", pieces(other))
        .withColumn(
            out,
            F.when(F.col(one) == F.col(other), F.lit(1.0))
            .when(F.col(one).isNotNull() & F.col(other).isNotNull(), F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect("_one", "_other")), both), F.lit(0.0))),
        )
        .drop("_one", "_other")
    )


def differing_paragraphs(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """One row for each paragraph of `one` that `other` has not: the pair's other columns, section, paragraph, start, n_chars.

    Roots are compared first, then sections, then the paragraphs of sections that differ; start is in code points."""
    rest = [c for c in pairs.columns if c not in (one, other)]
    differ = pairs.where(F.col(one)["root"] != F.col(other)["root"])
    known = differ.withColumn("_s", F.transform(F.col(other)["sections"], lambda s: s["hash"])).withColumn(
        "_p", F.flatten(F.transform(F.col(other)["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
    )
    size = lambda s: F.aggregate(s["paragraphs"], F.lit(0), lambda a, p: a + p["n_chars"])
    sections = known.withColumn("_sizes", F.transform(F.col(one)["sections"], size)).select(
        *rest, "_s", "_p", "_sizes", F.posexplode(F.col(one)["sections"]).alias("section", "_x")
    )
    edited = sections.where(~F.array_contains("_s", F.col("_x")["hash"])).withColumn(
        "_before", F.aggregate(F.slice("_sizes", F.lit(1), F.col("section")), F.lit(0), lambda a, n: a + n)
    )
    paragraphs = edited.select(
        *rest, "_p", "_before", "section", F.transform(F.col("_x")["paragraphs"], lambda p: p["n_chars"]).alias("_sizes"), F.posexplode(F.col("_x")["paragraphs"]).alias("paragraph", "_y")
    )
    return paragraphs.where(~F.array_contains("_p", F.col("_y")["hash"])).select(
        *rest,
        "section",
        "paragraph",
        (F.col("_before") + F.aggregate(F.slice("_sizes", F.lit(1), F.col("paragraph")), F.lit(0), lambda a, n: a + n)).alias("start"),
        F.col("_y")["n_chars"].alias("n_chars"),
    )


def with_first_difference(df: DataFrame, one: str, other: str, prefix: str) -> DataFrame:
    """Add <prefix>_section, <prefix>_paragraph (counted from 0) and <prefix>_start (code points): where `one` first departs
    from `other`, down to the paragraph; null where they are equal or only `other` goes on. Both are branches() of trees."""
    hashes = lambda xs: F.transform(xs, lambda x: x["hash"])
    first = lambda a, b: F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.isNotNull() & ~x.eqNullSafe(y)), True), F.lit(0)) - 1
    size = lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + p["n_chars"])
    within = lambda c: F.get(F.col(c), F.col(f"{prefix}_section").cast("int"))["paragraphs"]
    before = lambda xs, n: F.slice(xs, F.lit(1), n.cast("int"))
    sections = F.aggregate(before(F.col(one), F.col(f"{prefix}_section")), F.lit(0), lambda a, s: a + size(s["paragraphs"]))
    return (
        df.withColumn(f"{prefix}_section", first(hashes(F.col(one)), hashes(F.col(other))))
        .withColumn("_within", within(one))
        .withColumn(f"{prefix}_paragraph", first(hashes(F.col("_within")), F.coalesce(hashes(within(other)), F.array().cast("array<string>"))))
        .withColumn(f"{prefix}_start", (sections + size(before(F.col("_within"), F.col(f"{prefix}_paragraph")))).cast("long"))
        .drop("_within")
    )


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids: the next greater one, the smallest after the greatest.

    Ids are grouped by their high bits, level upon level; a group has at most 2^LEVEL_BITS members, and a level only one
    row for each group below. The number of levels follows from the smallest and the greatest id."""
    ends = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if ends[0] is None:
        return ids.select("doc_id", F.col("doc_id").alias("next_id"))
    levels, shift, nodes = [], LEVEL_BITS, ids.select("doc_id", F.col("doc_id").alias("first"))
    while True:
        group = F.shiftright("doc_id", min(shift, 63)) if shift < 64 else F.lit(0)
        led = nodes.withColumn("_g", group).withColumn("next_id", F.lead("first").over(W.partitionBy("_g").orderBy("first")))
        levels.append(led)
        if shift >= 64 or ends[0] >> shift == ends[1] >> shift:
            break
        nodes = led.groupBy("_g").agg(F.min("first").alias("first")).select(F.col("first").alias("doc_id"), "first")
        shift += LEVEL_BITS
    found = levels[-1].select("_g", "first", F.coalesce("next_id", F.lit(ends[0])).alias("next_id"))
    for led in reversed(levels[:-1]):
        above = found.select(F.col("first").alias("_head"), F.col("next_id").alias("_after"))
        heads = led.groupBy("_g").agg(F.min("first").alias("_head"), F.max("first").alias("_tail")).join(above, "_head")
        found = led.join(heads.select("_g", "_after"), "_g").select("_g", "first", F.coalesce("next_id", "_after").alias("next_id"))
    return found.select(F.col("first").alias("doc_id"), "next_id")


def with_next(docs: DataFrame, with_columns, columns: list[str]) -> DataFrame:
    """with_columns(docs), and next_<column> of each column: its value in the next row by doc_id and text, or in the
    first row after the last.

    Rows are shuffled once, to groups of neighbouring ids. The first rows of the groups are taken from the documents
    before any column is added, one from each partition and group, and get their columns again. Rows without a doc_id
    have no place in the order and are left out."""
    group = F.shiftright("doc_id", NEAR_BITS)
    known = docs.where("doc_id IS NOT NULL").withColumn("_g", group)
    order = W.partitionBy("_g").orderBy("doc_id", "text")
    led = with_columns(known)  # a window over a struct of columns would have them shuffled twice
    kept = [c for c in led.columns if c != "_g"]
    led = led.select("*", *[F.lead(c).over(order).alias(f"_next_{c}") for c in columns], F.lead("doc_id").over(order).alias("_follows"))
    heads = docs.where("doc_id IS NOT NULL").select("doc_id").groupBy(group.alias("_g")).agg(F.min("doc_id").alias("doc_id"))
    after = next_ids(heads.select("doc_id")).select(F.shiftright("doc_id", NEAR_BITS).alias("_g"), F.shiftright("next_id", NEAR_BITS).alias("_to"))
    first = with_columns(known.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row"))
    first = first.select(F.col("_g").alias("_to"), F.struct(*columns).alias("_first"))
    found = led.join(after.join(first, "_to").select("_g", "_first"), "_g", "left")
    got = lambda c: F.when(F.col("_follows").isNotNull(), F.col(f"_next_{c}")).otherwise(F.col("_first")[c])
    return found.select(*kept, *[got(c).alias(f"next_{c}") for c in columns])


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and edited_section, edited_paragraph and edited_start: where the text departs from its edited
    one, by descent through both trees."""
    docs = common.documents(spark, sf_dir).select("doc_id", common.text_or_empty().alias("text"))
    printed = lambda rows: with_tree(rows, "text", "_tree").withColumn("fingerprint", fingerprint("_tree")).withColumn("_branches", branches("_tree")).drop("_tree")
    paired = with_next(docs, printed, ["text", "fingerprint"])
    n = F.char_length("text")
    replaced = F.floor(n / 4).cast("int")
    edited = paired.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.left("text", n - replaced), F.left("next_text", replaced)))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    edited = with_tree(edited, "_edited", "_tree").withColumn("edited_fingerprint", fingerprint("_tree")).withColumn("_there", branches("_tree")).drop("_tree")
    located = with_first_difference(edited, "_branches", "_there", "edited")
    likened = with_likeness(with_likeness(located, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    places = ["edited_section", "edited_paragraph", "edited_start"]
    found = likened.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *places)
    alone = printed(docs.where("doc_id IS NULL")).select("doc_id", n.cast("long").alias("n_chars"), "fingerprint")
    return found.unionByName(alone, allowMissingColumns=True)
