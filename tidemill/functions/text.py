"""Text normalisation as Column expressions."""

from __future__ import annotations

import json
import string
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense; the engine's own class misses some of it.
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """White space runs to one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), f"{WS}+", " "))


#: What separates tokens. The letters stand one by one, as a class of single characters is one look into a table.
_SEPARATORS = f"[^{string.ascii_lowercase}{string.digits}]+"


def token(x: Column | str) -> Column:
    """Lower-case ASCII letters and digits with single spaces between; all else separates, white space of any kind too."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), _SEPARATORS, " "))


def posting_key(company: Column | str, position: Column | str) -> Column:
    return F.concat_ws("|", token(company), token(position))


def slug(x: Column | str) -> Column:
    """Letters and digits of any script, joined by '-'; 'job' if there are none."""
    dashed = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.trim(dashed, F.lit("-")), F.lit("")), F.lit("job"))


#: All named references come from the standard library's table; those without a semicolon also count in front of other text.
_NAMED = {f"&{name}": text for name, text in html5.items()}
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;|&(?:" + "|".join(_BARE) + ")"
#: Stands between the parts of a text that is cut at its references: a split at one character compiles no pattern per text.
_CUT = "\x01"
_PREFIX = "^(&(?:" + "|".join(_BARE) + "))(.*)$"


def _numbered(n: Column) -> Column:
    """The character of a numeric reference: code page 1252 from 128 to 159, nothing or U+FFFD for those that name none."""
    old = "".join(t if (t := bytes([c]).decode("cp1252", "replace")) != "\ufffd" else chr(c) for c in range(0x80, 0xA0))
    low = n.bitwiseAND(0xFFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
        .when(n.between(0x80, 0x9F), F.substr(F.lit(old), (n - 0x7F).cast("int"), F.lit(1)))
        .when(n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE), "")
        .otherwise(plain)
    )


def _referred(ref: Column, named: Column) -> Column:
    """What one reference stands for; one that names nothing stays as it is."""
    digits = F.regexp_extract(ref, "^&#0*([0-9]{1,9});?$", 1)
    digits16 = F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
    # more digits are beyond all characters
    number = F.coalesce(F.conv(F.nullif(digits16, F.lit("")), 16, 10), F.nullif(digits, F.lit(""))).cast("long")
    bare, rest = F.regexp_extract(ref, _PREFIX, 1), F.regexp_extract(ref, _PREFIX, 2)
    # one lookup: by the whole reference if the table has it, else by the name that it starts with
    whole = F.transform(F.array(named), lambda m: F.coalesce(F.try_element_at(m, ref), F.concat(F.try_element_at(m, bare), rest), ref))[0]
    return F.when(ref.startswith("&#"), _numbered(number)).otherwise(whole)


def unescape(x: Column) -> Column:
    """Every HTML character reference undone, once."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def undo(text: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), lambda r: _referred(r, named))
        gaps = F.when(F.contains(text, F.lit(_CUT)), F.split(text, _REFERENCE, -1)).otherwise(F.split(F.regexp_replace(text, _REFERENCE, _CUT), _CUT, -1))
        parts = F.zip_with(gaps, refs, lambda gap, r: F.concat(gap, F.coalesce(r, F.lit(""))))
        return F.when(F.regexp_like(text, F.lit("&[#A-Za-z]")), F.array_join(parts, "")).otherwise(text)

    # the one-element array binds the text to a name, so that it is made once
    return F.transform(F.array(x), undo)[0]


def strip_html(x: Column | str) -> Column:
    """Tags to spaces, then entities, then white space."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(col(x), F.lit("")), "<[^>]+>", " ")))


def title_of(position: Column | str = "position") -> Column:
    return F.lower(squeeze(position))


def body_of(*parts: Column | str) -> Column:
    """Lower-case position, description and location, one after another."""
    return F.lower(squeeze(F.concat_ws(" ", *[F.coalesce(col(p), F.lit("")) for p in parts])))


#: Escapes of the document format in the order in which they are applied.
_LATEX = (
    ("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"),
)


def latex(x: Column | str) -> Column:
    out = F.coalesce(col(x).cast("string"), F.lit(""))
    for a, b in _LATEX:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fill(template: Column | str, values: dict[str, Column | str]) -> Column:
    """Literal placeholders replaced by values, one after another."""
    out = col(template)
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), F.lit(value) if isinstance(value, str) else value)
    return out


def replace_section(template: Column | str, name: str, body: Column, following: str) -> Column:
    """All stretches from one section heading to the next heading replaced by body."""
    head, tail = (rf"\\section\{{{n}\}}" for n in (name, following))
    quoted = F.regexp_replace(body, r"([\\$])", r"\\$1")
    after = F.lit(f"\n\n\\\\section{{{following}}}")
    return F.regexp_replace(col(template), F.lit(f"(?s){head}.*?{tail}"), F.concat(quoted, after))


def sentences(x: Column | str) -> Column:
    """Split after . ! or ? where white space follows."""
    return F.split(squeeze(x), rf"(?<=[.!?]){WS}+")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(_array(phrases), lambda p: F.contains(text, p)) if phrases else F.lit(False)


def matching(text: Column, phrases: list[str]) -> Column:
    """The phrases inside text, in their order; a repeated phrase is found repeatedly."""
    return F.filter(_array(phrases), lambda p: F.contains(text, p))


def hits(text: Column, phrases: list[str]) -> Column:
    return F.size(matching(text, phrases)) if phrases else F.lit(0)


def points(text: Column, values: list[tuple[str, int]]) -> Column:
    """Sum of the points of all phrases inside text."""
    if not values:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("v")) for p, v in values])
    return F.aggregate(table, F.lit(0), lambda acc, x: acc + F.when(F.contains(text, x["p"]), x["v"]).otherwise(0))


def _array(phrases) -> Column:
    return F.array(*[F.lit(p) for p in phrases]) if phrases else F.array().cast("array<string>")
