"""Values as Python's json module and repr() write them, as column expressions; what audit chains hash and reviews quote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.let import let


def join_texts(*parts: str | Column) -> Column:
    """Columns and literal texts in a row; null where a column is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def python_float(value: Column) -> Column:
    """The fewest digits that give a double back: plain for exponents of -4 to 15, else with an exponent of two digits or more.

    Exact for values of up to 16 digits. Of those that need 17, the JVM's last digit is another one in rare cases (1 in some
    thousand of random bits), which gives the same double back; subnormal values may show digits too many.
    """
    def shown(x: Column) -> Column:
        tried = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
        exact = F.coalesce(*(F.when(t.try_cast("double") == x, t) for t in tried[:2]), tried[2])
        return let(F.split(exact, "e"), lambda s: _placed(F.regexp_replace(F.regexp_replace(F.get(s, F.lit(0)), "[-.]", ""), "0+$", ""), F.get(s, F.lit(1)).try_cast("int")))

    def _placed(digits: Column, exponent: Column) -> Column:
        def placed(d: Column) -> Column:
            d = F.when(d == "", "0").otherwise(d)
            whole = F.rpad(F.substring(d, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
            rest = F.substring(d, exponent + 2, F.length(d))
            small = join_texts("0.", F.repeat(F.lit("0"), -exponent - 1), d)
            power = join_texts(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
            far = join_texts(F.substring(d, 1, 1), F.when(F.length(d) > 1, join_texts(".", F.substring(d, F.lit(2), F.length(d)))).otherwise(""), "e", power)
            plain = F.when(exponent >= 0, join_texts(whole, ".", F.when(rest == "", "0").otherwise(rest))).otherwise(small)
            return F.when((exponent >= -4) & (exponent < 16), plain).otherwise(far)

        return let(digits, placed)

    negative = (value < 0) | (value.cast("string") == "-0.0")
    number = let(F.abs(value), shown)
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(F.when(negative, join_texts("-", number)).otherwise(number))


def _hex(code: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(code)), digits, "0")


def _by_character(text: Column, use) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), use), "")


def json_string(text: Column) -> Column:
    """A JSON string of ASCII alone; other characters are escaped, those beyond the first plane as two."""
    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        far = code - 0x10000
        pair = join_texts("\\u", _hex(F.shiftright(far, 10) + 0xD800, 4), "\\u", _hex(far.bitwiseAND(0x3FF) + 0xDC00, 4))
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
        out = F.when(c.isin('"', "\\", *"\n\r\t\f\b"), F.element_at(F.create_map(*(F.lit(x) for kv in short.items() for x in kv)), c))
        return out.when((code >= 32) & (code < 127), c).when(code < 0x10000, join_texts("\\u", _hex(code, 4))).otherwise(pair)

    return join_texts('"', F.when(text.rlike(r'[^ -~]|["\\]'), _by_character(text, escaped)).otherwise(text), '"')


def python_repr(text: Column) -> Column:
    """A text quoted as Python quotes it, None for null."""
    double = text.contains("'") & ~text.contains('"')

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when((c == "'") & ~double, "\\'")
        hidden = c.rlike(r"[\p{C}\p{Z}]") & (c != " ")
        return out.when(hidden & (code < 0x100), join_texts("\\x", _hex(code, 2))).when(hidden & (code < 0x10000), join_texts("\\u", _hex(code, 4))).when(hidden, join_texts("\\U", _hex(code, 8))).otherwise(c)

    quote = F.when(double, '"').otherwise("'")
    said = F.when(text.rlike(r"[\\'\p{C}\p{Z}&&[^ ]]"), _by_character(text, escaped)).otherwise(text)
    return F.when(text.isNull(), "None").otherwise(join_texts(quote, said, quote))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A column of any nested type as JSON text with keys in order at every depth, ", " and ": " between, ASCII alone.

    Nulls are kept, also as members of structs; maps need text keys, and come in the order of their code points. Doubles look as in
    Python (NaN and Infinity by those names); what JSON has no type for (times, dates, decimals, binaries' hexadecimal digits) is a string.
    """
    if isinstance(kind, T.StructType):
        parts = [join_texts(json_string(F.lit(f.name)), ": ", canonical_json(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = join_texts("{", F.concat_ws(", ", *parts) if parts else "", "}")
    elif isinstance(kind, T.ArrayType):
        text = join_texts("[", F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), "]")
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("maps need text keys")
        entry = lambda e: join_texts(json_string(e["key"]), ": ", canonical_json(e["value"], kind.valueType))
        ordered = F.transform(F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("key")))), lambda k: F.struct(k["key"].alias("key"), F.element_at(value, k["key"]).alias("value")))
        text = join_texts("{", F.array_join(F.transform(ordered, entry), ", "), "}")
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = python_float(value.cast("double"))
        text = F.when(shown == "nan", "NaN").when(shown == "inf", "Infinity").when(shown == "-inf", "-Infinity").otherwise(shown)
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        part = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        text = join_texts('"', part, F.when(micros == "000000", "").otherwise(join_texts(".", micros)), '"')
    else:
        text = json_string(F.lower(F.hex(value)) if isinstance(kind, T.BinaryType) else value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def canonical(df, *columns: str) -> Column:
    """canonical_json of one column of df, or of a document of several."""
    if len(columns) == 1:
        return canonical_json(F.col(columns[0]), df.schema[columns[0]].dataType)
    return canonical_json(F.struct(*columns), T.StructType([df.schema[c] for c in columns]))
