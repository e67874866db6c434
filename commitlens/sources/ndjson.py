"""Newline-delimited JSON ingest with explicit reject accounting.

A line is one of:

* ``blank``      - empty once surrounding whitespace is removed,
* ``malformed``  - not a JSON object of the expected shape,
* ``missing_key``- parsed, but a required key is NULL or empty,
* accepted.

A line is parsed once, into a typed value, by Spark's own JSON reader, so it
never leaves the JVM and a bad line never fails the job; the few lines that
value can't hold are read again in PERMISSIVE mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens import schemas as S
from commitlens.schemas import CORRUPT_COL, with_corrupt

REASON_COL = "_reason"
LINE_COL = "_line"
REJECT_REASONS = ["blank", "malformed", "missing_key"]

# Characters a line is stripped of before the blank test.
_WHITESPACE = " \t\r\n\x0b\x0c"

# Strict JSON, as a standard JSON decoder reads it: no single-quoted
# strings, comments, unquoted names or leading zeros (NaN/Infinity allowed).
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT_COL,
    "allowSingleQuotes": "false",
    "allowComments": "false",
    "allowUnquotedFieldNames": "false",
    "allowNumericLeadingZeros": "false",
    "allowNonNumericNumbers": "true",
}


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files as ``value`` plus a ``line_order`` struct that
    orders lines of the same file (file, split start, position in split).

    The order struct is what last-write-wins needs when a key repeats: a
    distributed read has no global line number, but within one file the
    split start and the per-task increasing id keep the file's order."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.text(paths)
    return df.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("line_order"),
    )


def _strict(raw: Column) -> Column:
    """The line is one JSON value and nothing else. ``from_json`` stops at the
    end of its value, so the line is also read as the one element of an
    array; text that closes that array itself (``],[``) is read as the one
    field of an object."""
    as_array = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,string>>", JSON_OPTIONS)
    one = F.coalesce((F.size(as_array) == 1) & as_array[0].isNotNull(), F.lit(False))
    as_object = F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), "map<string,string>", JSON_OPTIONS)
    return one & F.when(raw.rlike(r"\]\s*,\s*\["), F.coalesce(F.size(as_object) == 1, F.lit(False))).otherwise(F.lit(True))


def _variant(raw: Column, name: str) -> Column:
    """A top-level field with its JSON type."""
    schema = T.StructType([T.StructField(name, T.VariantType())])
    return F.from_json(raw, schema, JSON_OPTIONS)[name]


#: JSON text of the values a truth test takes for false (besides null and "").
_FALSY_TEXT = r"^(false|-?0(\.0*)?([eE][+-]?[0-9]+)?|\[\s*\]|\{\s*\})$"


def _falsy(raw: Column, name: str, text: Column) -> Column:
    """The field counts as absent: null, empty, or a number, boolean, array or
    object that is false (a string that reads like one is not)."""
    typed = F.schema_of_variant(_variant(raw, name)) != F.lit("STRING")
    return text.isNull() | (text == F.lit("")) | F.when(text.rlike(_FALSY_TEXT), F.coalesce(typed, F.lit(False))).otherwise(F.lit(False))


_PLAIN_INT = r"^\s*[+-]?[0-9]+\s*$"
_LONG_LIMIT = 9.2e18


def _int_text(value: Column) -> Column:
    """Text of int(value) for a JSON number or boolean; strings stay. A number
    with a fraction or an exponent is a double, cut towards zero."""
    kind, text = F.schema_of_variant(value), value.cast("string")
    number = text.try_cast("double")
    return (
        F.when(kind == F.lit("BOOLEAN"), F.when(text == F.lit("true"), F.lit("1")).otherwise(F.lit("0")))
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
              F.when(F.abs(number) < F.lit(_LONG_LIMIT), number.try_cast("bigint").cast("string")).otherwise(text))
        .otherwise(text)
    )


def _as_ints(raw: Column, f: T.StructField, value: Column) -> Column:
    """A field whose numbers are read as int() does: plain integers as they
    are, other forms by their JSON type."""
    if f.name in S.INT_TEXT_FIELDS and isinstance(f.dataType, T.StringType):
        odd = value.isNotNull() & ~value.rlike(_PLAIN_INT)
        return F.when(odd, _int_text(_variant(raw, f.name))).otherwise(value)
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
        names = f.dataType.elementType.fieldNames()
        ints = [n for n in names if n in S.INT_TEXT_FIELDS]
        if ints:
            loose = T.ArrayType(T.StructType([T.StructField(n, T.VariantType() if n in ints else t.dataType)
                                              for n, t in zip(names, f.dataType.elementType.fields)]))
            again = F.from_json(raw, T.StructType([T.StructField(f.name, loose)]), JSON_OPTIONS)[f.name]
            odd = F.exists(value, lambda x: F.coalesce(~x[ints[0]].rlike(_PLAIN_INT), F.lit(False)))
            fixed = F.transform(again, lambda x: F.struct(*[(_int_text(x[n]) if n in ints else x[n]).alias(n) for n in names]))
            return F.when(odd, fixed).otherwise(value)
    return value


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often and
    wherever they are used later: Catalyst copies expressions into filters
    and fields, but not those of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def is_blank(line: Column) -> Column:
    return line.isNull() | (F.btrim(line, F.lit(_WHITESPACE)) == F.lit(""))


#: Text put behind a line's value: only a line that is one value and nothing
#: else leaves an array of that value and this text. Lines that hold the text
#: itself take the second path.
_END = "end of line 5d1f"


def _one_value(line: Column) -> Column:
    """The line as the first element of an array that :data:`_END` ends; NULL if
    that can't be parsed, or repeats a key, or holds NaN or Infinity."""
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{_END}"]')))


def _field(value: Column, name: str) -> Column:
    """A top-level field of the line's value, with its JSON type."""
    return F.try_variant_get(value, f'$[0]["{name}"]', "variant")


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _false(value: Column) -> Column:
    """A typed value that a truth test takes for false."""
    text = value.cast("string")
    is_text = F.schema_of_variant(value) == F.lit("STRING")
    return value.isNull() | text.isNull() | (text == F.lit("")) | (~is_text & text.rlike(_FALSY_TEXT))


def _boxes(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]


def _int_entries(f: T.StructField) -> list[str]:
    """The entries of an array of objects whose numbers are read as int() does."""
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
        return [n for n in f.dataType.elementType.fieldNames() if n in S.INT_TEXT_FIELDS]
    return []


def _read_as(f: T.StructField, boxes: list[T.StructField]) -> str:
    """The type a field is taken from the line's value as: its own, or a typed
    value where the JSON type still decides."""
    if ints := _int_entries(f):
        entries = ", ".join(f"`{x.name}`: {'variant' if x.name in ints else x.dataType.simpleString()}" for x in f.dataType.elementType.fields)
        return f"array<struct<{entries}>>"
    if f in boxes or isinstance(f.dataType, T.StringType) and f.name not in S.INT_TEXT_FIELDS:
        return f.dataType.simpleString()
    return "variant"


def _typed(own: Column, f: T.StructField, boxes: list[T.StructField]) -> Column:
    """A field, read as :func:`_read_as` says, as its type."""
    if ints := _int_entries(f):
        return F.transform(own, lambda x: F.struct(*[(_int_text(x[n]) if n in ints else x[n]).alias(n) for n in f.dataType.elementType.fieldNames()]))
    if f in boxes or isinstance(f.dataType, T.StringType):
        return _int_text(own) if f.name in S.INT_TEXT_FIELDS else own
    return F.when(F.schema_of_variant(own) == F.lit("BIGINT"), own.try_cast(f.dataType))


def _wrong(value: Column, fields: Column, schema: T.StructType, boxes: list[T.StructField]) -> Column:
    """The type of some field is wrong. A box that was read is right; what else
    one may hold is looked at, in a lambda as in :func:`_second_path`, where one is missing."""
    def check(v: Column) -> Column:
        bad = F.lit(False)
        for f in boxes:
            own = _field(v, f.name)
            bad = bad | (fields[f.name].isNull() & own.isNotNull() & ~_false(own))
        return F.coalesce(bad, F.lit(False))

    missing, out = F.lit(False), F.lit(False)
    for f in boxes:
        missing = missing | fields[f.name].isNull()
    if boxes:
        out = F.coalesce(F.get(F.transform(F.when(missing, F.array(value)).otherwise(F.array().cast("array<variant>")), check), F.lit(0)), F.lit(False))
    for f in schema.fields:
        if f not in boxes and not isinstance(f.dataType, T.StringType):
            out = out | F.coalesce(~F.schema_of_variant(fields[f.name]).isin("BIGINT", "VOID"), F.lit(False))
    return out


def _second_path(line: Column, schema: T.StructType, required: Sequence[str], odd: Column) -> Column:
    """The fields, ``malformed`` and ``key_ok`` of an odd line (NULL for others):
    lines that repeat a key, hold NaN or Infinity, or can't be parsed. These are
    read with the field types, then with loose containers, as :func:`from_json`
    takes them. Spark evaluates a lambda only for the entries of its array, so
    the many expressions of this path cost nothing on a line that is not odd, nor
    do they swell the generated code that all lines pass through."""
    boxes = _boxes(schema)
    loose = T.StructType([T.StructField(f.name, T.VariantType() if f in boxes else f.dataType) for f in schema.fields])

    def fields(raw: Column, rec: Column, again: Column | None) -> Column:
        broken = rec.isNull() | rec[CORRUPT_COL].isNotNull()
        values, usable = {}, F.lit(False) if again is None else again.isNotNull() & again[CORRUPT_COL].isNull()
        for f in schema.fields:
            first = rec[f.name]
            if again is None:
                values[f.name] = first
            elif f not in boxes:
                values[f.name] = F.when(broken, again[f.name]).otherwise(first)
            else:
                box = again[f.name]
                text = box.cast("string")
                absent = box.isNull() | (F.schema_of_variant(box) == F.lit("VOID")) | text.rlike(_FALSY_TEXT) | (text == F.lit(""))
                whole = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), with_corrupt(T.StructType([T.StructField("v", f.dataType)])), JSON_OPTIONS)
                good = (F.schema_of_variant(box) != F.lit("STRING")) & whole[CORRUPT_COL].isNull()
                usable = usable & (absent | F.coalesce(good, F.lit(False)))
                values[f.name] = F.when(broken, F.when(~absent, whole["v"])).otherwise(first)
        malformed = (broken & ~F.coalesce(usable, F.lit(False))) | ~_strict(raw)
        key_ok: Column = F.lit(True)
        for k in required:
            key_ok = key_ok & ~_falsy(raw, k, values[k])
        return F.struct(*[_as_ints(raw, f, values[f.name]).alias(f.name) for f in schema.fields], malformed.alias("malformed"), key_ok.alias("key_ok"))

    def again(raw: Column, rec: Column) -> Column:
        broken = rec.isNull() | rec[CORRUPT_COL].isNotNull()
        return F.when(broken, F.from_json(raw, with_corrupt(loose), JSON_OPTIONS))

    def read(raw: Column) -> Column:
        first = F.from_json(raw, with_corrupt(schema), JSON_OPTIONS)
        if not boxes:
            return _let(first, lambda rec: fields(raw, rec, None))
        return _let(first, lambda rec: _let(again(raw, rec), lambda loosely: fields(raw, rec, loosely)))

    return F.get(F.transform(F.when(odd, F.array(line)).otherwise(F.array().cast("array<string>")), read), F.lit(0))


def classify_ndjson(
    lines: DataFrame,
    schema: T.StructType,
    required: Sequence[str] = (),
    value_col: str = "value",
) -> DataFrame:
    """Parse every line; keep other input columns; add the record fields, the
    raw line (``_line``) and a reject reason (``_reason``, NULL if accepted).

    A line must be one JSON object and nothing else. An object or array field
    that holds a false value of another type (``""``, ``0``, ``false``, ``[]``,
    ``{}``) counts as absent, any other type is malformed; a required key that
    holds one is missing. Fields in ``schemas.INT_TEXT_FIELDS`` take the forms
    int() takes.

    A line is parsed once, into a value that keeps its JSON types; fields,
    types and truth are read from that. Only lines it can't be made of (see
    :func:`_second_path`) are parsed again."""
    passthrough = [c for c in lines.columns if c != value_col]
    parsed = _once(lines.select(*passthrough, F.col(value_col).alias(LINE_COL)), _value=_one_value(F.col(LINE_COL)))
    line, value = F.col(LINE_COL), F.col("_value")
    odd = ~is_blank(line) & (value.isNull() | F.contains(line, F.lit(_END)))
    parsed = _once(parsed, _odd=odd, _second=_second_path(line, schema, required, odd))

    ended = F.coalesce(F.try_variant_get(value, "$[1]", "string") == F.lit(_END), F.lit(False)) & F.try_variant_get(value, "$[2]", "variant").isNull()
    is_object = F.startswith(F.btrim(line, F.lit(" \t\r\n")), F.lit("{"))
    # all fields in one pass over the object
    boxes = _boxes(schema)
    read_as = ", ".join(f"`{f.name}`: {_read_as(f, boxes)}" for f in schema.fields)
    parsed = _once(parsed, _whole=ended & is_object, _fields=F.try_variant_get(value, "$[0]", f"struct<{read_as}>"))
    own = F.col("_fields")
    parsed = _once(parsed, _wrong=_wrong(value, own, schema, boxes))

    key_ok = F.lit(True)
    for k in required:
        text = own[k] if k in schema.fieldNames() and _read_as(schema[k], boxes) == "string" else None
        if text is None:
            key_ok = key_ok & ~_false(_field(value, k))
        else:  # text that reads like a false value is looked at again
            key_ok = key_ok & text.isNotNull() & (text != F.lit("")) & F.when(text.rlike(_FALSY_TEXT), ~_false(_field(value, k))).otherwise(F.lit(True))
    is_odd, second = F.col("_odd"), F.col("_second")
    fields = {f.name: F.when(is_odd, second[f.name]).otherwise(_typed(own[f.name], f, boxes).cast(f.dataType)) for f in schema.fields}
    reason = (
        F.when(is_blank(line), F.lit("blank"))
        .when(F.when(is_odd, second["malformed"]).otherwise(~F.col("_whole") | F.col("_wrong")), F.lit("malformed"))
        .when(~F.when(is_odd, second["key_ok"]).otherwise(key_ok), F.lit("missing_key"))
    )
    done = _once(parsed, **{"_record": F.struct(*[c.alias(n) for n, c in fields.items()]), REASON_COL: reason})
    return done.select(*passthrough, *[F.col("_record")[n].alias(n) for n in fields], line, REASON_COL)


def accepted(classified: DataFrame, keep_line: bool = False) -> DataFrame:
    """Accepted records of a classified frame, without the bookkeeping
    columns (``keep_line=True`` keeps the raw line as ``_line``)."""
    out = classified.where(F.col(REASON_COL).isNull()).drop(REASON_COL)
    return out if keep_line else out.drop(LINE_COL)


def rejected(classified: DataFrame) -> DataFrame:
    """Rejected lines with their reason."""
    return classified.where(F.col(REASON_COL).isNotNull()).select(
        F.col(LINE_COL).alias("line"), F.col(REASON_COL).alias("reason")
    )


def parse_ndjson(
    lines: DataFrame,
    schema: T.StructType,
    required: Sequence[str] = (),
    value_col: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` frames of a lines frame."""
    classified = classify_ndjson(lines, schema, required, value_col)
    return accepted(classified), rejected(classified)


def outcome_counts() -> list[Column]:
    """An aggregate per outcome (``accepted`` or a reject reason) over a
    classified frame."""
    reason = F.coalesce(F.col(REASON_COL), F.lit("accepted"))
    return [F.count_if(reason == F.lit(o)).cast("bigint").alias(o) for o in ["accepted", *REJECT_REASONS]]


def reject_counts(classified: DataFrame) -> DataFrame:
    """One row per outcome (``accepted`` or a reject reason) with its line
    count; every outcome is listed, zero when absent. A single global
    aggregate, so it is one partial aggregation per task."""
    counts = classified.agg(*outcome_counts())
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("line_count")) for o in counts.columns]))
    )


def read_ndjson(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    required: Sequence[str] = (),
) -> DataFrame:
    """Classified records of NDJSON files (see :func:`classify_ndjson`)."""
    return classify_ndjson(read_lines(spark, path), schema, required)
