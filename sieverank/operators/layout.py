"""Lines and columns from the words of a page: words(doc_id, page, seq, text, x0, x1, top, bottom, bold, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import clean_cid, let, text_of, trim_blank
from sieverank.operators.sections import resolve_headers

TOLERANCE, LEAST_GAP = 3.5, 20.0


def span_text(text: Column) -> Column:
    """The text of a span without marks of unknown glyphs; letters spaced out as in "W O R K  D A Y S" are put together,
    where every letter of the span is: two blanks part words."""
    clean = clean_cid(text_of(text))
    parts = F.transform(F.split(trim_blank(clean), "  "), lambda p: F.replace(p, F.lit(" "), F.lit("")))
    spaced = trim_blank(clean).rlike(r"^\S(?: \S)+(?:  \S(?: \S)+)*$")
    return F.when(spaced, F.array_join(parts, " ")).otherwise(clean)


#: Words whose places are added up in one go: a running sum as one fold copies what it has for each word of a text.
BLOCK_WORDS = 16


def _running(lengths: Column) -> Column:
    """For each number of an array the sum of those before it: sums within blocks, after the sums of the blocks before."""
    def before(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        return F.aggregate(xs, start, step, lambda s: s["all"])

    def summed(lengths: Column) -> Column:
        last = F.floor((F.size(lengths) - 1) / BLOCK_WORDS).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * BLOCK_WORDS + 1, BLOCK_WORDS))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
        return let(blocks, lambda blocks: F.flatten(F.zip_with(blocks, before(F.transform(blocks, total)), lambda xs, base: F.transform(before(xs), lambda x: x + base))))

    return let(lengths, summed)


def _placed(spans: DataFrame, spaced: Column | None = None) -> DataFrame:
    """The spans that have words, with _words, the place _starts of each in the text, _width of a character, _one (word)."""
    whole = span_text(F.col("text"))
    rows = spans.withColumn("_text", whole if spaced is None else F.when(spaced, whole).otherwise(clean_cid(text_of(F.col("text")))))
    found = F.regexp_extract_all("_text", F.lit(r"(\S+)"), F.lit(1))
    rows = rows.filter(F.col("_text").rlike(r"\S")).withColumn("_words", found)
    # A gap stands before each word, and one, perhaps empty, after the last.
    gaps = F.slice(F.transform(F.split("_text", r"\S+"), F.length), F.lit(1), F.size("_words"))
    rows = rows.withColumn("_gaps", gaps).withColumn("_before", _running(F.zip_with("_gaps", "_words", lambda g, w: g + F.length(w))))
    width = (F.col("x1") - F.col("x0")) / F.length("_text")
    return rows.withColumns({"_starts": F.zip_with("_before", "_gaps", lambda b, g: b + g), "_width": width, "_one": F.size("_words") == 1})


def _bold() -> Column:
    return F.contains(F.lower(F.coalesce("font", F.lit(""))), F.lit("bold")).alias("bold")


def _size() -> Column:
    return F.coalesce("size", F.lit(0.0)).cast("double").alias("size")


def words_of_spans(spans: DataFrame, spaced: Column | None = None) -> DataFrame:
    """doc_id, page, seq, text, x0, x1, top, bottom, bold, size: the words of spans(doc_id, page, seq, text, x0, y0, x1,
    y1, font, size), with the span's width dealt out by characters, blanks included, so that words keep their gaps.

    A span without words gives none; a single word has the whole span. Null coordinates stay null. Each row stands for
    itself: repeated spans repeat their words, nothing is shuffled. `spaced` says which spans may be set in spaced
    letters (by default each may be); in the others single letters are words.
    """
    words = _placed(spans, spaced).select("*", F.explode(F.arrays_zip("_words", "_starts")).alias("w"))
    first, last = F.col("w._starts"), F.col("w._starts") + F.length("w._words")
    return words.select(
        "doc_id",
        "page",
        "seq",
        F.col("w._words").alias("text"),
        F.when(F.col("_one"), F.col("x0")).otherwise(F.col("x0") + first * F.col("_width")).alias("x0"),
        F.when(F.col("_one"), F.col("x1")).otherwise(F.col("x0") + last * F.col("_width")).alias("x1"),
        F.col("y0").alias("top"),
        F.col("y1").alias("bottom"),
        _bold(),
        _size(),
    )


def page_lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, page, line, text, top, x0, bold, size: a word within `tolerance` of its line's first word joins it.

    The anchor moves with each new line, which no window frame can say; a page is a small group and is read in one row.
    """
    return _lines(words.select("doc_id", "page", "seq", "top", "bold", "size", F.array(F.struct("text", "x0")).alias("words")), tolerance)


def lines_of_spans(spans: DataFrame, spaced: Column | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """page_lines(words_of_spans(spans, spaced), tolerance) without a row for each word: the words of a span have its top,
    so that spans go to their lines whole."""
    # The optimizer may put the width into the body of a lambda: there it would be worked out for each word.
    across = F.struct("x0", F.when(F.col("_one"), 0.0).otherwise(F.col("_width")).alias("width"))
    words = let(across, lambda span: F.zip_with("_words", "_starts", lambda w, at: F.struct(w.alias("text"), (span["x0"] + at * span["width"]).alias("x0"))))
    return _lines(_placed(spans, spaced).select("doc_id", "page", "seq", F.col("y0").alias("top"), _bold(), _size(), words.alias("words")), tolerance)


def _lines(pieces: DataFrame, tolerance: float) -> DataFrame:
    """page_lines() of pieces(doc_id, page, seq, top, bold, size, words: array of text, x0); one without a top joins its
    page's last line, words without a start end theirs."""
    number = lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    top = number(F.col("top"))
    piece = F.struct(top.isNull().alias("last"), top.alias("top"), "seq", F.coalesce("bold", F.lit(False)).alias("bold"), number(F.col("size")).alias("size"), "words")
    pages = pieces.groupBy("doc_id", "page").agg(F.collect_list(piece).alias("p"))
    # Pieces that the order leaves open stay as they came.
    pages = pages.withColumn("p", F.sort_array(F.transform("p", lambda x, i: F.struct(x["last"], x["top"], i.alias("i"), x["seq"], x["bold"], x["size"], x["words"]))))
    kind = pages.schema["p"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast(f"array<{kind}>").alias("lines"))

    def step(s: Column, x: Column) -> Column:
        n = F.size(s["lines"])
        opens = (n == 0) | F.coalesce(x["top"] - s["anchor"] > tolerance, F.lit(False))
        joined = F.concat(F.slice(s["lines"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(s["lines"], n - 1), F.array(x))))
        return F.struct(F.when(opens, x["top"]).otherwise(s["anchor"]).alias("anchor"), F.when(opens, F.concat(s["lines"], F.array(F.array(x)))).otherwise(joined).alias("lines"))

    rows = pages.select("doc_id", "page", F.posexplode(F.aggregate("p", start, step, lambda s: s["lines"])).alias("line", "l"))

    def word(x: Column) -> Column:
        return F.transform(x["words"], lambda w, i: F.struct(number(w["x0"]).isNull().alias("last"), number(w["x0"]).alias("x0"), x["seq"].alias("seq"), x["i"].alias("i"), i.alias("k"), w["text"].alias("text"), x["bold"].alias("bold"), x["size"].alias("size")))

    rows = rows.select("doc_id", "page", "line", F.get("l", F.lit(0))["top"].alias("top"), F.sort_array(F.flatten(F.transform("l", word))).alias("w"))
    sizes = F.filter(F.transform("w", lambda w: w["size"]), lambda x: x.isNotNull())
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(sizes), F.lit(0))
    return rows.select(
        "doc_id", "page", F.col("line").cast("int").alias("line"), F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), "top",
        F.get("w", F.lit(0))["x0"].alias("x0"), F.forall("w", lambda w: w["bold"]).alias("bold"), mean.alias("size"),
    )


def column_split(words: DataFrame, page_width: float, least: float = LEAST_GAP) -> DataFrame:
    """doc_id, page, split: the middle of the widest stretch without a word's start in 10 to 75 % of the width."""
    starts = words.select("doc_id", "page", F.floor("x0").cast("double").alias("x")).distinct().filter(F.col("x").between(page_width * 0.1, page_width * 0.75))
    gaps = starts.withColumn("gap", F.lead("x").over(Window.partitionBy("doc_id", "page").orderBy("x")) - F.col("x"))
    best = gaps.filter(F.col("gap") >= least).groupBy("doc_id", "page").agg(F.max(F.struct("gap", -F.col("x"))).alias("m"))
    return best.select("doc_id", "page", (F.col("m.gap") / 2 - F.col("m.col2")).alias("split"))


def header_band(words: DataFrame, size: float = 14.0, height: float = 120.0) -> DataFrame:
    """doc_id, page, band: `height` below the first bold word that is larger than `size`; null without one."""
    large = F.col("bold") & (F.col("size") > size)
    return words.groupBy("doc_id", "page").agg((F.min(F.when(large, F.col("top"))) + height).alias("band"))


def columns_of(words: DataFrame, splits: DataFrame) -> DataFrame:
    """words with `column`: full where a page has no split, else left or right; the sides change names where the left one
    has more than three times the words of the right one."""
    sided = words.join(splits, ["doc_id", "page"], "left").withColumn("left", F.col("x0") < F.col("split"))
    counts = sided.groupBy("doc_id", "page").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r"))
    both = sided.join(counts, ["doc_id", "page"])
    swap = F.col("l") > 3 * F.col("r")
    name = F.when(F.col("split").isNull(), "full").when(F.col("left") != swap, "left").otherwise("right")
    return both.withColumn("column", name).drop("left", "l", "r", "split")


def bold_size(lines: DataFrame) -> DataFrame:
    """doc_id, size: the most frequent size of a document's bold lines, the smaller one on ties."""
    n = lines.filter("bold").groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))


def layout_class(lines: DataFrame) -> DataFrame:
    """doc_id, layout: table where more than 0.3 of the lines have a bar, two_column with lines in a left column beside
    others, else single."""
    bars = F.avg(F.contains("text", F.lit("|")).cast("double"))
    rows = lines.groupBy("doc_id").agg(bars.alias("bars"), F.bool_or(F.col("column") == "left").alias("left"), F.bool_or(F.col("column") != "left").alias("other"))
    return rows.select("doc_id", F.when(F.col("bars") > 0.3, "table").when(F.col("left") & F.col("other"), "two_column").otherwise("single").alias("layout"))


def tagged_text(lines: DataFrame) -> DataFrame:
    """doc_id, column, text: the lines of each column in page order, with their roles as tags; body lines have none."""
    tag = F.upper("role")
    text = F.when(F.col("role") == "body", F.col("text")).otherwise(F.concat(F.lit("["), tag, F.lit("]"), F.col("text"), F.lit("[/"), tag, F.lit("]")))
    rows = lines.withColumn("t", text).groupBy("doc_id", "column").agg(F.array_sort(F.collect_list(F.struct("page", "line", "t"))).alias("l"))
    return rows.select("doc_id", "column", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def section_blocks(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, section, first, last, text: what each header rules; a line about references ends the last block."""
    marked = resolve_headers(lines.withColumnRenamed("text", "raw").withColumn("at", F.col("page") * 100_000 + F.col("line")), headers, "raw")
    ended = F.lower("raw").rlike(r"references?\s+(?:are\s+)?available")
    opened = marked.withColumn("block", F.when(F.col("section").isNotNull() | ended, F.struct("at", F.when(~ended, F.col("section")).alias("name"))))
    ruled = opened.withColumn("block", F.last("block", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    body = ruled.filter("block.name is not null and section is null")
    rows = body.groupBy("doc_id", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("l"))
    return rows.select("doc_id", F.col("block.name").alias("section"), "first", "last", F.array_join(F.transform("l", lambda x: x["raw"]), "\n").alias("text"))


def line_roles(lines: DataFrame, title_size: float = 14.0) -> DataFrame:
    """lines with `role`: header (bold capitals, at most five words), title (large and bold), bullet, date or body."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    role = (
        F.when(F.col("bold") & (F.col("size") > title_size), "title")
        .when(F.col("bold") & (F.upper("text") == F.col("text")) & (words <= 5), "header")
        .when(F.col("text").rlike(r"^\s*[•·▪▸►✓✔*-]"), "bullet")
        .when(F.col("text").rlike(r"\b(?:19|20)\d{2}\b") & (words <= 6), "date")
        .otherwise("body")
    )
    return lines.withColumn("role", role)
