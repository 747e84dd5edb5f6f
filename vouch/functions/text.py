"""Text rules: name matching, spreadsheet cells, report text, redaction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed


def name_matches(name: Column, patterns: Iterable[str]) -> Column:
    """True when the trimmed lower-case name contains any of the patterns."""
    return F.lower(F.trim(name)).rlike("|".join(f"(?:{p})" for p in patterns))


def value_matches(value: Column, pattern: str) -> Column:
    """True when the value, apart from surrounding white space, is one whole match."""
    return value.cast("string").rlike(rf"\A\s*(?:{pattern})\s*\z")


def spreadsheet_safe(text: Column) -> Column:
    """Missing becomes empty; text a spreadsheet would run as a formula gets a leading quote."""
    guarded = F.when(text.rlike(fixed.FORMULA_PATTERN), F.concat(F.lit("'"), text)).otherwise(text)
    return F.coalesce(guarded, F.lit(""))


def _double_json_sql(value: str) -> str:
    """SQL text of a double with the fewest digits that give it back; an exponent below 1e-4 and from 1e16 on."""
    text = f"cast({value} as string)"
    plain = f"regexp_replace(regexp_replace(cast(cast({text} as decimal(38,21)) as string), '0+$', ''), '[.]$', '.0')"
    power = f"cast(regexp_extract({text}, 'E(-?[0-9]+)$', 1) as int)"
    scaled = (f"concat(regexp_replace(regexp_extract({text}, '^(-?[0-9.]+)E', 1), '[.]0$', ''), 'e', "
              f"if({power} < 0, '-', '+'), lpad(cast(abs({power}) as string), greatest(2, length(cast(abs({power}) as string))), '0'))")
    return (f"case when isnan({value}) or abs({value}) = double('Infinity') then {text} "
            f"when {value} = 0 then {text} when abs({value}) >= 1e-4D and abs({value}) < 1e16D then {plain} else {scaled} end")


def json_sql(value: str, kind: T.DataType) -> str:
    """SQL text of a value as JSON: keys sorted, ``, `` and ``: `` between parts, letters as they are.

    Fields of a record that are null are left out: they belong to other kinds of record.
    """
    if isinstance(kind, T.StructType):
        cells = [f"case when {value}.{f.name} is not null then concat('\"{f.name}\": ', {json_sql(f'{value}.{f.name}', f.dataType)}) end"
                 for f in sorted(kind.fields, key=lambda f: f.name)]
        return f"if({value} is null, null, concat('{{', concat_ws(', ', {', '.join(cells)}), '}}'))"
    if isinstance(kind, T.ArrayType):
        return f"concat('[', array_join(transform({value}, _x -> {json_sql('_x', kind.elementType)}), ', ', 'null'), ']')"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double_json_sql(value)
    if isinstance(kind, T.StringType):
        made = f"to_json(named_struct('v', {value}))"
        return f"substring({made}, 6, length({made}) - 6)"
    return f"cast({value} as string)"


def plain_report_text(text: Column) -> Column:
    """Strip headings, bold marks and rules; normalise bullets to ``- ``."""
    out = F.regexp_replace(text, r"(?m)^#{1,6}\s*", "")
    out = F.regexp_replace(out, r"\*\*(.*?)\*\*", "$1")
    out = F.regexp_replace(out, r"(?m)^\s*[-*]\s+", "- ")
    out = F.replace(out, F.lit("---"), F.lit(""))
    out = F.regexp_replace(out, r"^\s+|\s+\z", "")
    return F.coalesce(out, F.lit(""))


def redact(text: Column, secrets: Iterable[str] = ()) -> Column:
    """Blank out the listed secrets and every bearer credential."""
    out = text
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit(fixed.SECRET_REPLACEMENT))
    return F.regexp_replace(out, fixed.BEARER_PATTERN, fixed.BEARER_REPLACEMENT)


def template_sql(pattern: str, fields: dict[str, str]) -> str:
    """SQL text filling the ``{field}`` places of a sentence; null when a named field is null."""
    parts: list[str] = []
    for index, piece in enumerate(_split(pattern)):
        if piece:
            parts.append(fields[piece] if index % 2 else f"'{piece}'")
    return f"concat({', '.join(parts)})"


def _split(pattern: str) -> list[str]:
    pieces: list[str] = []
    rest = pattern
    while "{" in rest:
        literal, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        pieces += [literal, field]
    return pieces + [rest]
