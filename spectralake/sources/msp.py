"""MSP spectral libraries as text: records are blank-line separated blocks, so Spark splits and filters the files itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
PEAK = rf"^\s*({NUMBER})\s+({NUMBER})(?:\s+(.*))?$"
#: Blanks, tabs and page breaks before a peak.
BLANK = " \t\x0b\f"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(block: Column) -> Column:
    """Lines without blanks around them; line feeds with or without carriage returns end one."""
    return F.filter(F.transform(F.split(F.translate(block, "\r", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _field(lines: Column, name: str) -> Column:
    """The text after the first ``name:`` in the header, whatever its case; null without one."""
    hits = F.filter(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == name)
    return F.regexp_extract(F.get(hits, F.lit(0)), r"^[^:]*:\s*(.*)$", 1)


def _comment(text: Column, name: str) -> Column:
    """A named part of the comment, which ends where the next known one begins."""
    found = F.regexp_extract(text, rf"(?i)(?:^|;)\s*{name}=(.*?)(?:;\s*(?:ms1_name|polarity)=.*)?$", 1)
    return F.when(found != "", F.trim(found))


def _header(block: Column) -> Column:
    """The header fields of a block; _rest is what follows ``num peaks:``."""

    def fields(parts: Column, head: Column) -> Column:
        # the first line of a name counts; without one there is no position, so null
        text = lambda name: F.get(head["texts"], F.array_position(head["names"], name).cast("int") - 1)
        rest = F.get(parts, F.lit(1))
        comments = _bound(F.coalesce(text("comment"), F.lit("")), lambda c: F.struct(_comment(c, "ms1_name").alias("ms1_name"), _comment(c, "polarity").alias("polarity")))
        return F.struct(
            F.nullif(text("name"), F.lit("")).alias("name"), text("precursormz").try_cast("double").alias("precursor_mz"), F.nullif(text("precursortype"), F.lit("")).alias("adduct"),
            F.nullif(text("compoundclass"), F.lit("")).alias("compound_class"), F.nullif(text("formula"), F.lit("")).alias("formula"), comments.alias("_c"),
            F.trim(F.substring_index(F.translate(F.coalesce(rest, F.lit("")), "\r", "\n"), "\n", 1)).try_cast("int").alias("n_peaks"), rest.alias("_rest"),
        )

    def head(lines: Column) -> Column:
        names = F.transform(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
        return F.struct(names.alias("names"), F.transform(lines, lambda x: F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1)).alias("texts"))

    split = F.split(block, r"(?i)(?:^|\n)\s*num peaks\s*:", 2)
    return _bound(split, lambda p: _bound(_bound(_lines(F.get(p, F.lit(0))), head), lambda h: fields(p, h)))


def headers(blocks: DataFrame, column: str = "value") -> DataFrame:
    """The header fields of each block that has a precursor, without its peaks."""
    # a block gives one record or none: a filter on a later column would read every block twice
    found = F.filter(F.array(_header(F.col(column))), lambda h: h["precursor_mz"].isNotNull())
    out = blocks.select(F.inline(found))
    return out.select("name", "precursor_mz", "adduct", "compound_class", "formula", "_c.ms1_name", "_c.polarity", "n_peaks", "_rest")


def _peaks(lines: Column) -> Column:
    """Peak lines as mz, intensity, name, type, required_group, weight: labels in quotes are name and type, or a JSON object of all.

    Each transform binds what the next one uses more than once, so a line is split, cut at its quotes and read as JSON once.
    """
    parts = F.transform(lines, lambda x: F.split(F.trim(x, F.lit(BLANK)), r"\s+", 3))
    cut = F.transform(parts, lambda p: F.struct(p.alias("p"), F.split(F.get(p, F.lit(2)), '"').alias("cut")))
    rest = lambda p: F.trim(F.coalesce(F.get(p["p"], F.lit(2)), F.lit("")))
    whole = lambda r: r.startswith('"') & r.endswith('"') & (F.length(r) >= 2)
    inner = lambda r: F.when(whole(r), F.substring(r, 2, F.length(r) - 2)).otherwise(r)
    json = lambda p: F.when(F.contains(F.get(p["p"], F.lit(2)), F.lit("{")), _bound(inner(rest(p)), lambda r: F.when(F.ltrim(r).startswith("{"), F.from_json(r, "name string, type string, required_group string, weight double"))))
    # what stands between the first two quotes, and between the next two
    quoted = lambda p, i: F.when(F.size(p["cut"]) > 2 * i, F.get(p["cut"], F.lit(2 * i - 1)))
    kind = lambda p: F.when(F.size(p["cut"]) > 4, F.coalesce(F.nullif(quoted(p, 2), F.lit("")), F.lit("Common"))).otherwise("Common")

    def plain(p: Column) -> Column:
        named = [F.coalesce(quoted(p, 1), rest(p)).alias("name"), kind(p).alias("type"), F.lit(None).cast("string").alias("required_group"), F.lit(1.0).alias("weight")]
        return F.struct(F.get(p["p"], F.lit(0)).cast("double").alias("mz"), F.get(p["p"], F.lit(1)).cast("double").alias("intensity"), *named)

    def labelled(p: Column, j: Column) -> Column:
        plain_ = plain(p)
        named = [F.coalesce(j["name"], plain_["name"]).alias("name"), F.coalesce(j["type"], plain_["type"]).alias("type"), F.nullif(j["required_group"], F.lit("")).alias("required_group"), F.coalesce(j["weight"], F.lit(1.0)).alias("weight")]
        return F.struct(plain_["mz"].alias("mz"), plain_["intensity"].alias("intensity"), *named)

    return F.transform(cut, lambda p: F.when(F.contains(F.get(p["p"], F.lit(2)), F.lit("{")), _bound(json(p), lambda j: labelled(p, j))).otherwise(plain(p)))


def records(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Header fields and ``fragments`` in the order of the file; lines that aren't peaks are left out."""
    lines = F.filter(F.slice(_lines(F.concat(F.lit("-\n"), F.coalesce("_rest", F.lit("")))), 2, 1 << 30), lambda x: x.rlike(PEAK))
    return headers(blocks, column).withColumn("fragments", _peaks(lines)).drop("_rest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below ``path`` (plain or compressed), with record_id; blank lines may hold carriage returns.

    Blocks are cut at line feeds, and a file with carriage returns is cut again at blank lines inside the pieces.
    """
    pieces = spark.read.option("lineSep", "\n\n").text(path)
    blocks = pieces.select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n|\r\n[ \t]*\r\n")).alias("value"))
    found = records(blocks).withColumn("record_id", F.monotonically_increasing_id())
    name = F.coalesce("ms1_name", "name")
    return found.withColumn("lipid_name", name)


def block(name: Column, mz: Column, adduct: Column, compound_class: Column, fragments: Column) -> Column:
    """One record as text; fragments have mz, intensity and name."""
    lines = F.transform(fragments, lambda p: F.format_string('%s %s "%s"', p["mz"].cast("string"), p["intensity"].cast("string"), p["name"]))
    head = F.format_string("Name: %s\nPrecursorMZ: %s\nPrecursorType: %s\nCompoundClass: %s\nNum Peaks: %d", name, mz.cast("string"), adduct, compound_class, F.size(fragments))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"))


def full_block() -> Column:
    """A record with all its fields: four digits of masses, two of intensities, name and type of each fragment."""
    lines = F.transform("fragments", lambda p: F.format_string('%.4f %.2f "%s" "%s"', p["mz"], p["intensity"], p["name"], p["type"]))
    formula = F.when(F.coalesce("formula", F.lit("")) != "", F.concat(F.lit("Formula: "), F.col("formula")))
    comment = F.format_string("Comment: MS1_name=%s;polarity=%s", F.coalesce("ms1_name", "name"), F.coalesce("polarity", F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("Name: "), F.col("name")), F.format_string("PrecursorMZ: %.4f", F.col("precursor_mz")), F.concat(F.lit("PrecursorType: "), F.col("adduct")), F.concat(F.lit("CompoundClass: "), F.col("compound_class")), formula, comment, F.format_string("Num Peaks: %d", F.size("fragments")), F.array_join(lines, "\n"))


def faults(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Blocks that lack or repeat a header, or whose number of peaks is wrong or 0, with what is wrong."""
    lines = _lines(F.col(column))
    keys = ["name", "precursormz", "precursortype", "compoundclass", "num peaks"]
    count = lambda k: F.size(F.filter(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == k))
    n = F.size(F.filter(lines, lambda x: x.rlike(PEAK)))
    said = _field(lines, "num peaks").try_cast("int")
    wrong = F.array_compact(F.array(*[F.when(count(k) != 1, k) for k in keys], F.when((n == 0) | (F.coalesce(said, F.lit(-1)) != n), "peaks")))
    return blocks.select(column, wrong.alias("wrong")).where(F.size("wrong") > 0)


def write(blocks: DataFrame, path: str, column: str = "value") -> None:
    blocks.select(column).write.option("lineSep", "\n\n").text(path)
