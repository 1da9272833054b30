"""Noise in text from scanned pages: page furniture, words broken over lines, misread characters.

All evidence is counted over the whole corpus by grouped aggregates. Lines are only ever ordered
within a page, so a source of any size is spread over many tasks; a word broken over a page break
finds its second part by a join on the page number.

Two spellings are confusable if they have the same ``fold``: letters that scanners mix up fall into
one class. The fold makes fuzzy comparison of words a hash join. Lines at page edges repeat fuzzily:
their folds may differ by a few lost, doubled or wrong letters from a line that stands on many pages
of the source, of which a source has a bounded number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verispan.scale import attach, fenced, spread, written

# Letters that scanners read as two, which are spelled out first; then single characters by class.
GROUPS = (("m", "rn"), ("w", "vv"), ("u", "ii"), ("d", "cl"))
CLASSES = ("oO0", "ilt1f!|", "s5", "g9q", "ec", "hb68", "z2", "a4")
HYPHENS = "-\u2010\u00ad\u00ac"
HEADINGS_SHARE = 0.6
"""A line belongs to the page edge if so large a part of its occurrences in the corpus is there."""
PAGES_SHARE = 0.25
"""A header of a source stands on at least so large a part of its pages; headers may alternate."""
CENTER_SHARE = 0.1
"""A line that fuzzy repetition is measured against stands unchanged on at least so large a part of the pages: at most 20 a side."""
RATIO = 8
"""A word is misread if a confusable word is at least so many times as frequent."""
WORD = r"[\p{L}\p{N}]++(?:[-‐][\p{L}\p{N}]++)*+"


NUMBER_LINE = r"(?i)^[\[(\-–—|•.\s]*(?:page|p\.|pp\.|seite|pag\.)?\s*([0-9]{1,5})\s*[\])\-–—|•.\s]*(?:(?:/|of|von)\s*[0-9]{1,5}\s*)?$"
NUMBER_HEAD = r"^\s*([0-9]{1,5})\s*(?:\||\s{2,}|[-–—]\s)\s*(?=\S)|(?<=\S)\s*(?:\||\s{2,}|\s[-–—])\s*([0-9]{1,5})\s*$"


def fold(text: Column) -> Column:
    """The class string of a text in which confusable spellings are equal."""
    out = F.lower(F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")))
    for a, b in GROUPS:
        out = F.replace(out, F.lit(a), F.lit(b))
    src = "".join(c[1:] for c in CLASSES)
    dst = "".join(c[0] * (len(c) - 1) for c in CLASSES)
    return F.translate(out, src, dst)


def page_lines(blocks: DataFrame, source: str, ordinal: str, block: str, locator: str, kind: str, original: str) -> DataFrame:
    """The non-empty lines of all blocks with their place; blocks without a page locator are pages of their own."""
    at = F.regexp_extract(F.coalesce(F.col(locator), F.lit("")), r"(?i)^page ([0-9]{1,9})(?:, text block ([0-9]{1,9}))?", 0)
    page = F.regexp_extract(F.col(locator), r"(?i)^page ([0-9]{1,9})", 1)
    blk = F.regexp_extract(F.col(locator), r"(?i)text block ([0-9]{1,9})", 1)
    df = spread(blocks.select(source, ordinal, block, locator, kind, original)).select(
        F.col(source).alias("source_id"),
        F.coalesce(at != "", F.lit(False)).alias("paged"),
        F.when(at != "", page.cast("int")).otherwise(F.col(ordinal)).alias("page"),
        F.when(blk != "", blk.cast("int")).otherwise(F.col(ordinal)).alias("blk"),
        F.col(block).alias("block_id"),
        F.col(kind).alias("kind"),
        F.posexplode(F.split(original, "\r?\n", -1)).alias("i", "line"),
    )
    df = df.select("source_id", "paged", "page", "blk", "block_id", "kind", (F.col("i") + 1).alias("line_no"), "line").filter(F.trim("line") != "")
    # what is left of a line without a page number at its ends, for comparison of lines
    bare = F.when(F.col("line").rlike(r"^\s*[0-9]|[0-9]\s*$"), F.regexp_replace("line", NUMBER_HEAD, "")).otherwise(F.col("line"))
    df = fenced(df, {"bare": F.when(F.col("paged"), F.regexp_replace(F.trim(bare), r"\s+", " "))})
    return written(df.withColumn("key", fold(F.col("bare"))).drop("bare"), "page-lines")


def nearest(key: Column, centers: Column) -> Column:
    """The key of the center that ``key`` differs least from, by at most one letter in eight and two in all; null if there is none."""
    most = lambda c: F.least(F.lit(2), F.floor(F.length(c["key"]) / 8)).cast("int")
    off = F.transform(centers, lambda c: F.struct(F.levenshtein(key, c["key"]).alias("d"), (-c["n"]).alias("n"), c["key"].alias("key"), most(c).alias("most")))
    return F.array_min(F.filter(off, lambda x: x["d"] <= x["most"]))["key"]


def furniture(lines: DataFrame) -> DataFrame:
    """``source_id, page, blk, block_id, line_no, noise_kind`` of running headers, footers and page numbers."""
    at = W.partitionBy("source_id", "page").orderBy("blk", "block_id", "line_no")
    whole = W.partitionBy("source_id", "page")
    edge = lines.filter("paged").withColumns({"up": F.row_number().over(at), "n": F.count("*").over(whole)})
    edge = edge.withColumn("down", F.col("n") - F.col("up") + 1)
    text = F.trim("line")
    only = F.regexp_extract(text, NUMBER_LINE, 1)
    inside = F.coalesce(F.nullif(F.regexp_extract("line", NUMBER_HEAD, 1), F.lit("")), F.regexp_extract("line", NUMBER_HEAD, 2))
    edge = edge.filter("up <= 2 or down <= 2").select(
        "source_id", "page", "blk", "block_id", "line_no", "up", "down", text.alias("line"), "key",
        (only != "").alias("is_number"), F.when(only != "", only).when(inside != "", inside).cast("int").alias("number"),
        F.when(F.col("up") <= F.col("down"), "head").otherwise("foot").alias("side"),
    )
    edge = written(edge, "page-edges")
    # the page number runs with the page: most numbers of a source have the same distance to it
    numbered = edge.filter("number is not null").withColumn("off", F.col("number") - F.col("page"))
    runs = numbered.groupBy("source_id", "off").agg(F.countDistinct("page").alias("pages"))
    best = runs.groupBy("source_id").agg(F.max(F.struct("pages", (-F.abs("off")).alias("o"), "off")).alias("b"), F.count("*").alias("offsets"))
    best = written(best.select("source_id", F.col("b.off").alias("off"), F.col("b.pages").alias("run"), "offsets"), "page-runs")
    # the line at the edges of pages of other sources
    everywhere = lines.filter("paged").groupBy("key").agg(F.count("*").alias("everywhere"))
    # an edge line may be counted from both ends on short pages; by key it is one occurrence per line
    corpus = edge.filter("not is_number").groupBy("key", "source_id").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("at_edges"), F.count("*").alias("sources"))
    corpus = written(corpus.join(everywhere, "key").withColumn("share", F.col("at_edges") / F.col("everywhere")), "edge-keys")
    # on other pages of the source: lines are near one that stands unchanged on many pages
    pages = edge.groupBy("source_id").agg(F.countDistinct("page").alias("pages"))
    edge = written(attach(attach(edge, best, ["source_id"]), pages, ["source_id"]), "page-edges")
    same = edge.filter("not is_number").groupBy("source_id", "side", "key").agg(F.countDistinct("page").alias("n"), F.first("pages").alias("pages"))
    often = same.filter((F.col("n") >= 2) & (F.col("n") >= CENTER_SHARE * F.col("pages")))
    centers = written(often.groupBy("source_id", "side").agg(F.collect_list(F.struct("n", "key")).alias("centers")), "edge-centers")
    edge = attach(edge, centers, ["source_id", "side"])
    edge = fenced(edge, {"center": nearest(F.col("key"), F.col("centers"))}).drop("centers")
    edge = written(edge, "page-edges")
    own = edge.filter("not is_number and center is not null").groupBy("source_id", "side", "center").agg(F.countDistinct("page").alias("own_pages"), F.first("pages").alias("pages"))
    own = written(own.filter((F.col("own_pages") >= 2) & (F.col("own_pages") >= PAGES_SHARE * F.col("pages"))), "own-edges")
    edge = written(attach(edge, own.select("source_id", "side", "center", "own_pages"), ["source_id", "side", "center"]), "page-edges")
    edge = attach(edge, corpus.select("key", "share", "sources"), ["key"])
    runs_with = F.coalesce((F.col("number") - F.col("page")) == F.col("off"), F.lit(False))
    adorned = ~F.col("line").rlike(r"^[0-9]+$")
    page_number = F.col("is_number") & runs_with & ((F.col("run") >= 2) | (F.col("offsets") == 1) & (adorned | (F.col("off") == 0)))
    letters = F.col("line").rlike(r"\p{L}{2}")
    apart = F.coalesce(F.col("share") >= HEADINGS_SHARE, F.lit(False))
    sentence = F.col("line").rlike(r"[.,;:]$") & ~F.col("line").rlike(r"(?i)\bet al\.$")
    starts = F.col("line").rlike(r"^[^\p{Ll}]")
    repeated = F.col("own_pages").isNotNull() & apart & starts & ~sentence
    titled = ~F.col("line").rlike(r"(^|\s)\p{Ll}{4}")  # a heading in capitals, as names of journals are
    common = (F.col("sources") >= 3) & apart & ~sentence & starts & titled
    with_number = ~F.col("is_number") & runs_with & ((F.col("run") >= 2) | apart)
    authors = F.col("line").rlike(r"^\p{Lu}\S* et al\.$") & (F.least("up", "down") == 1)
    header = letters & (repeated | common | with_number | authors) & ~F.col("is_number")
    noise = F.when(page_number, "page_number").when(header, "running_header")
    return edge.select("source_id", "page", "blk", "block_id", "line_no", noise.alias("noise_kind")).filter(F.col("noise_kind").isNotNull())


def body_lines(lines: DataFrame, noise: DataFrame) -> DataFrame:
    """The lines that remain, each with the text that follows and the text before it in reading order."""
    place = ["source_id", "page", "blk", "block_id", "line_no"]
    rest = lines.join(noise.select(*place), place, "left_anti").drop("key")
    at = W.partitionBy("source_id", "page").orderBy("blk", "block_id", "line_no")
    rest = rest.withColumns({"next": F.lead("line").over(at), "before": F.lag("line").over(at)})
    rest = written(rest, "body-lines")
    # over a page break: only the last line of a page that ends in a hyphen looks for the next page
    first = rest.filter("paged and before is null").groupBy("source_id", "page").agg(F.min_by("line", F.struct("blk", "line_no")).alias("turned"))
    last = rest.filter("paged and next is null").groupBy("source_id", "page").agg(F.max_by("line", F.struct("blk", "line_no")).alias("came"))
    broken = F.col("line").rlike(f"[{HYPHENS}]\\s*$")
    tops, ends = F.col("before").isNull() & F.col("paged"), F.col("next").isNull() & F.col("paged") & broken
    turned = first.select("source_id", (F.col("page") - 1).alias("page"), "turned")
    came = last.filter(F.col("came").rlike(f"[{HYPHENS}]\\s*$")).select("source_id", (F.col("page") + 1).alias("page"), "came")
    inner = rest.filter(~(tops | ends)).withColumns({"turned": F.lit(None).cast("string"), "came": F.lit(None).cast("string")})
    outer = rest.filter(tops | ends).join(turned, ["source_id", "page"], "left").join(came, ["source_id", "page"], "left")
    out = inner.unionByName(outer)
    out = out.withColumns({"next": F.coalesce("next", F.when(broken, F.col("turned"))), "before": F.coalesce("before", "came")}).drop("turned", "came")
    return written(out, "body-lines")


def ends_broken(line: str) -> Column:
    """Whether a line ends in a hyphen; spares most lines the search for the word before it."""
    return F.coalesce(F.substring(F.rtrim(F.col(line), F.lit(" \t\x0b\f\r\n")), -1, 1).isin(list(HYPHENS)), F.lit(False))


def plain(word: Column) -> Column:
    return F.translate(F.lower(word), "‐", "-")


def repairs(body: DataFrame) -> DataFrame:
    """``source_id, block_id, line_no, noise_kind, found, second, repaired`` of broken and misread words."""
    tail = rf"({WORD})[{HYPHENS}]\s*$"
    head = rf"^\s*({WORD})"
    first = F.when(ends_broken("line"), F.regexp_extract("line", tail, 1)).otherwise("")
    text = fenced(body.filter(F.coalesce(F.col("kind"), F.lit("text")) != "table"), {"first": first})
    first = F.col("first")
    second = F.when(first.rlike(r"\p{L}$"), F.regexp_extract("next", head, 1))
    text = fenced(text, {"second": second})
    second = F.col("second")
    is_broken = (first != "") & F.coalesce(second.rlike(r"^\p{L}"), F.lit(False))
    # the second part of a word broken on the line before is no word of this line
    was = F.when(ends_broken("before"), F.regexp_extract("before", tail, 1).rlike(r"\p{L}$") & F.regexp_extract("line", head, 1).rlike(r"^\p{L}"))
    own = F.when(is_broken, F.regexp_replace("line", tail, "")).otherwise(F.col("line"))
    own = F.when(F.coalesce(was, F.lit(False)), F.regexp_replace(own, head, "")).otherwise(own)
    tokens = fenced(text, {"own": own}).select("source_id", "block_id", "line_no", F.explode(F.regexp_extract_all(F.col("own"), F.lit(f"({WORD})"), F.lit(1))).alias("found"))
    tokens = tokens.filter(F.col("found").rlike(r"\p{L}"))
    words = tokens.groupBy("found").agg(F.count("*").alias("n"))
    vocab = words.withColumn("word", plain(F.col("found"))).groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("found") != F.upper("found"), F.col("n")).otherwise(0)).alias("lower_n"))
    vocab = written(vocab.withColumn("fold", fold(F.col("word"))), "vocabulary")
    sound = vocab.filter(~F.col("word").rlike(r"\p{L}[0-9]|[0-9]\p{L}|[ﬁﬂ]"))
    top = written(sound.groupBy("fold").agg(F.max(F.struct("n", "word")).alias("top")), "folds")
    mixed = F.col("word").rlike(r"\p{L}[0-9]|[0-9]\p{L}|[ﬁﬂ]")
    bad = vocab.filter((F.col("lower_n") > 0) & ((F.length("word") > 2) | mixed)).join(top, "fold")
    bad = bad.filter((F.col("top.word") != F.col("word")) & (F.col("top.n") >= 3) & (F.col("top.n") >= F.when(mixed, 2).otherwise(RATIO) * F.col("n")))
    bad = written(bad.select("word", F.col("top.word").alias("repaired"), "n"), "misread")
    chars = attach(tokens.filter(F.col("found") != F.upper("found")).withColumn("word", plain(F.col("found"))), bad, ["word"], "inner", weight="n")
    chars = chars.select("source_id", "block_id", "line_no", F.lit("char").alias("noise_kind"), "found", F.lit(None).cast("string").alias("second"), "repaired")
    # broken words: decided once per distinct pair of parts
    pairs = text.filter(is_broken).select("source_id", "block_id", "line_no", first.alias("found"), second.alias("second"), F.regexp_extract("line", rf"([{HYPHENS}])\s*$", 1).alias("mark"))
    pairs = written(pairs.withColumns({"a": plain(F.col("found")), "b": plain(F.col("second")), "soft": F.col("mark") == "\u00ad"}), "broken")
    distinct = pairs.groupBy("a", "b", "soft").agg(F.count("*").alias("times"))
    forms = distinct.select("a", "b", "soft", "times", F.explode(F.array(F.struct(F.lit("joined").alias("form"), F.concat("a", "b").alias("w")), F.struct(F.lit("compound").alias("form"), F.concat_ws("-", "a", "b").alias("w")), F.struct(F.lit("last").alias("form"), F.regexp_extract("a", r"([^-]+)$", 1).alias("w")), F.struct(F.lit("second").alias("form"), F.regexp_extract("b", r"^([^-]+)", 1).alias("w")))).alias("f"))
    forms = forms.select("a", "b", "soft", "times", "f.form", "f.w", fold(F.col("f.w")).alias("fold"))
    exact = vocab.select(F.col("word").alias("w"), "n")
    # distinct forms: no key is frequent here
    forms = forms.join(exact, "w", "left").join(top, "fold", "left")
    near = F.when((F.col("form") != "last") & (F.col("form") != "second") & (F.col("top.n") >= RATIO * F.coalesce("n", F.lit(0))) & (F.col("top.n") >= 3), F.col("top.word"))
    forms = forms.withColumns({"spelled": F.coalesce(near, "w"), "seen": F.when(near.isNotNull(), F.col("top.n")).otherwise(F.coalesce("n", F.lit(0)))})
    pick = lambda form, c: F.max(F.when(F.col("form") == form, F.col(c)))
    chosen = forms.groupBy("a", "b", "soft", "times").agg(*[pick(f, c).alias(f"{f}_{c}") for f in ("joined", "compound", "last", "second") for c in ("spelled", "seen")])
    two_words = (F.col("last_seen") >= 3) & (F.col("second_seen") >= 3)
    unseen = F.when(~F.col("soft") & two_words, F.col("compound_spelled")).otherwise(F.col("joined_spelled"))
    whole = (
        F.when((F.col("joined_seen") == 0) & (F.col("compound_seen") == 0), unseen)
        .when(F.col("compound_seen") > F.col("joined_seen"), F.col("compound_spelled"))
        .otherwise(F.col("joined_spelled"))
    )
    chosen = written(chosen.select("a", "b", "soft", "times", whole.alias("repaired")), "mended")
    hyphens = attach(pairs, chosen, ["a", "b", "soft"], "inner", weight="times")
    hyphens = hyphens.select("source_id", "block_id", "line_no", F.lit("hyphen").alias("noise_kind"), "found", "second", "repaired")
    return hyphens.unionByName(chars)


def scan_noise(blocks: DataFrame, source: str = "source_id", ordinal: str = "ordinal", block: str = "block_id", locator: str = "locator", kind: str = "kind", original: str = "original") -> DataFrame:
    """``source_id, block_id, line_no, noise_kind, repaired``, distinct.

    Defined cases: null and empty texts have no lines; a block without a page locator has no page
    edges and its words are only joined within the block; tables keep their lines and are searched
    for furniture only; a null kind is text; repeated blocks count as evidence once each but give
    one row; an empty table gives an empty result; other columns are ignored.
    """
    lines = page_lines(blocks, source, ordinal, block, locator, kind, original)
    edges = written(furniture(lines), "furniture")
    words = repairs(body_lines(lines, edges))
    out = edges.select("source_id", "block_id", "line_no", "noise_kind", F.lit("").alias("repaired"))
    return out.unionByName(words.select("source_id", "block_id", "line_no", "noise_kind", "repaired")).distinct()


def repaired_paragraphs(blocks: DataFrame, source: str = "source_id", ordinal: str = "ordinal", block: str = "block_id", locator: str = "locator", kind: str = "kind", original: str = "original") -> DataFrame:
    """``source_id, page, blk, block_id, kind, continued, text``: each block as one repaired paragraph.

    Blocks that are furniture throughout are gone. The first part of a broken word is completed and
    its second part is dropped where it stood, also over a page break. ``continued`` marks a block
    that ends inside a sentence, so that it runs on in the next block of ``(page, blk)`` order.
    """
    lines = page_lines(blocks, source, ordinal, block, locator, kind, original)
    edges = written(furniture(lines), "furniture")
    body = body_lines(lines, edges)
    fixes = written(repairs(body), "repairs").distinct()
    per_line = fixes.groupBy("source_id", "block_id", "line_no").agg(
        F.collect_set(F.when(F.col("noise_kind") == "char", F.struct("found", "repaired"))).alias("chars"),
        F.max(F.when(F.col("noise_kind") == "hyphen", F.struct("found", "second", "repaired"))).alias("broken"),
    )
    rows = body.join(per_line, ["source_id", "block_id", "line_no"], "left")
    tail, head = rf"({WORD})[{HYPHENS}]\s*$", rf"^\s*{WORD}\S*\s?"
    was = F.regexp_extract("before", tail, 1).rlike(r"\p{L}$") & F.col("line").rlike(r"^\s*\p{L}") & (F.coalesce(F.col("kind"), F.lit("text")) != "table")
    after = F.regexp_extract("next", rf"^\s*{WORD}([^\s\p{{L}}\p{{N}}]*)", 1)
    line = F.when(F.coalesce(was, F.lit(False)), F.regexp_replace("line", head, "")).otherwise(F.col("line"))
    line = F.when(F.col("broken").isNotNull(), F.concat(F.regexp_replace(line, tail, ""), F.col("broken.repaired"), after)).otherwise(line)
    keep = lambda good, bad: F.when(bad.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(good, 1, 1)), good.substr(F.lit(2), F.length(good)))).otherwise(good)
    line = F.when(F.size("chars") > 0, F.aggregate("chars", line, lambda t, p: F.replace(t, p["found"], keep(p["repaired"], p["found"])))).otherwise(line)
    sep = F.when(F.col("kind") == "table", "\n").otherwise(" ")
    texts = rows.groupBy("source_id", "paged", "page", "blk", "block_id", "kind").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim(line).alias("line")))).alias("ls"))
    text = F.call_function("array_join", F.filter(F.col("ls")["line"], lambda x: x != ""), sep)
    texts = texts.withColumn("text", text).filter(F.col("text") != "")
    return texts.select("source_id", "page", "blk", "block_id", "kind", (F.col("paged") & ~F.col("text").rlike(r"[.!?:)\]\"']$") & F.col("text").rlike(r"\s")).alias("continued"), "text")
