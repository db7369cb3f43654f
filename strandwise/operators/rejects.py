"""Delimited records that fail to parse, separated from those that load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"
#: Priority of the reasons, first wins.
REASONS = ("quoting", "column_count", "blank_id", "invalid_date")
#: What the reader takes for white space though it is none here.
CONTROLS = r"[\x00-\x08\x0A-\x1F]"
#: Columns of the widest header that gets a reader's schema; records of wider sources are all classified as corrupt ones are.
WIDEST = 512
#: Closes every record that is read, so that what the reader leaves out is seen.
END = "."
#: Stands for a comma inside quotes while a record is cut; a code point that text never holds.
ASIDE = "\ufdd0"
CLOSES, OPENS, TURNS = r"\A[ \t]*(,|\z)", r"(\A|,)[ \t]*\z", r"(?s)\A[ \t]*,(.*,)?[ \t]*\z"


def _fields_by_quotes(record: Column) -> tuple[Column, Column]:
    """(are the quoting rules kept?, the fields) of a record.

    Cut at each quote, the odd pieces lie inside quotes and the even ones outside, as a doubled
    quote turns twice around an empty piece.  An outside piece between two quotes must
    therefore be empty, or close one field and open another; the first must end where a field
    opens, the last begin where one closes.  No piece is scanned twice, whatever its length.
    """
    pieces = F.split(record, '"', -1)
    between = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    turns = F.forall(F.transform(between, lambda x, i: (i % 2 == 0) | (x == "") | x.rlike(TURNS)), lambda x: x)
    quoted = (F.size(pieces) % 2 == 1) & F.element_at(pieces, 1).rlike(OPENS) & F.element_at(pieces, -1).rlike(CLOSES) & turns
    good = (F.size(pieces) == 1) | quoted
    # Commas inside quotes step aside so that the outside ones cut the record.
    masked = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.translate(x, ",", ASIDE)).otherwise(x)), '"')

    def content(field: Column) -> Column:
        bare = F.btrim(field, F.lit(BLANKS))
        quoted = F.btrim(F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"')), F.lit(BLANKS))
        return F.translate(F.when(bare.startswith('"'), quoted).otherwise(bare), ASIDE, ",")

    return good, F.transform(F.split(masked, ",", -1), content)


def valid_date(text: Column) -> Column:
    """Is it yyyy-MM-dd, yyyy-MM or yyyy in ASCII digits, naming a day or month that exists?"""
    shape = text.rlike(r"\A[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?\z")
    y, m, d = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    size = F.length(text)
    return F.coalesce(shape & ((size < 7) | m.between(1, 12)) & ((size < 10) | d.between(1, days)), F.lit(False))


def headers(raw: DataFrame, id_column: str = "sequence_id", date_column: str = "collection_date") -> DataFrame:
    """(source, width, id_at, date_at) from line 1 of each source; positions count from 1, 0 if absent."""
    line = F.regexp_replace(F.regexp_replace("raw_record", r"\A\x{FEFF}", ""), r"\r\z", "")
    _, names = _fields_by_quotes(line)
    return (
        raw.where(F.col("line_number") == 1)
        .select("source", names.alias("names"))
        .groupBy("source")
        .agg(F.min("names").alias("names"))
        .select("source", F.col("names"), F.size("names").alias("width"), F.array_position("names", id_column).alias("id_at"), F.array_position("names", date_column).alias("date_at"))
    )


def judged_records(raw: DataFrame, id_column: str = "sequence_id", date_column: str = "collection_date") -> DataFrame:
    """(source, line_number, record, names, fields, reason) of every record after line 1; a null reason loads.

    Every record meets its source's header and is read permissively under an explicit schema of string columns, as many as
    the widest header has; records of narrower sources are filled up to it first.  So a record with
    another number of columns than its header comes out of the reader as corrupt, with its raw text.  Those
    are classified again by quoting and number of columns, and so are records of which the reader leaves a quote
    in a field, as it forgives quotes out of place.  A record that it reads whole keeps the fields it read.
    Blank ids and dates are then judged on the fields.

    White-space records are skipped.  Records with a null source, null text or null line number
    are no records and are skipped too.  A source without line 1 has no width: all its
    records fail with ``column_count`` unless their quoting fails first.  Records given twice
    come out twice.  A source with a third of all rows is split by Spark's skew join against
    its single header row.
    """
    heads = headers(raw, id_column, date_column)
    widest = heads.where(F.col("width") <= WIDEST).agg(F.max("width")).first()[0] or 1
    record = F.regexp_replace("raw_record", r"\r\z", "")
    body = raw.where((F.col("line_number") != 1) & F.col("source").isNotNull() & F.col("raw_record").isNotNull())
    body = body.select("source", "line_number", record.alias("record")).where(~F.col("record").rlike(r"(?U)\A\s*\z")).join(heads, "source", "left")

    schema = ", ".join([*(f"c{i} string" for i in range(widest)), "_end string", "_corrupt string"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "maxColumns": str(2 * widest + 2)}
    commas = F.length("record") - F.length(F.translate("record", ",", ""))
    readable = (F.col("width") <= widest) & (commas <= widest) & ~F.col("record").rlike(CONTROLS)
    filled = F.concat("record", F.repeat(F.lit(","), F.lit(widest) - F.col("width")), F.lit("," + END))
    # A generator reads each record once, however many expressions look at its columns; the same for the fields.
    kept = ["source", "line_number", "record", "names", "width", "id_at", "date_at"]
    parsed = body.select(*kept, F.inline(F.array(F.from_csv(F.when(readable, filled), schema, options))))
    columns = F.slice(F.array(*[F.coalesce(F.btrim(F.col(f"c{i}"), F.lit(BLANKS)), F.lit("")) for i in range(widest)]), F.lit(1), F.least(F.col("width"), F.lit(widest)))
    forgiven = F.coalesce(F.contains(F.concat_ws("", *[f"c{i}" for i in range(widest)]), F.lit('"')), F.lit(False))
    whole = F.coalesce(F.col("_corrupt").isNull() & (F.col("_end") == END) & ~forgiven, F.lit(False))
    good, again = _fields_by_quotes(F.col("record"))
    fields = F.struct(F.when(whole, F.lit(True)).otherwise(good).alias("_well_quoted"), F.when(whole, columns).otherwise(again).alias("fields"))
    joined = parsed.select(*kept, F.inline(F.array(fields)))
    at = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.element_at("fields", F.greatest(F.col(c), F.lit(1)).cast("int")))
    day = F.coalesce(at("date_at"), F.lit(""))
    reason = (
        F.when(~F.col("_well_quoted"), "quoting")
        .when(F.col("width").isNull() | (F.size("fields") != F.col("width")), "column_count")
        .when(F.coalesce(at("id_at"), F.lit("")) == "", "blank_id")
        .when((day != "") & ~valid_date(day), "invalid_date")
    )
    return joined.select("source", "line_number", "record", "names", "fields", reason.alias("reason"))


def rejected_records(raw: DataFrame, **kw: object) -> DataFrame:
    """(source, line_number, reason) of the records that fail."""
    return judged_records(raw, **kw).where(F.col("reason").isNotNull()).select("source", F.col("line_number").cast("bigint").alias("line_number"), "reason")


def loaded_records(raw: DataFrame, columns: tuple[str, ...] = ("sequence_id", "collection_date", "location", "host"), **kw: object) -> DataFrame:
    """(source, line_number, one string column per name) of the records that load; a column its source lacks is null."""
    good = judged_records(raw, **kw).where(F.col("reason").isNull())
    at = lambda c: F.array_position("names", c)
    return good.select("source", F.col("line_number").cast("bigint").alias("line_number"), *[F.when(at(c) > 0, F.nullif(F.element_at("fields", F.greatest(at(c), F.lit(1)).cast("int")), F.lit(""))).alias(c) for c in columns])
