"""Text functions: Column to Column, in built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import running

#: Fixed values of the text rules: ASCII white space, the units' punctuation, Cyrillic capitals that are lower-cased.
SPACE = r"[\x09-\x0D ]"
PUNCTUATION = (",", ".", "!", "?", ";", ":", "(", ")", "-", "*", "—", "–", "«", "»", "…", "...", "“", "„", '"')
PHRASE_PUNCTUATION = (",", ".", "!", "?", ";", ":", "-", "(", ")")
UPPER = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁІЄ"
LOWER = "абвгдежзийклмнопрстуфхцчшщъыьэюяёіє"
MARK = r'[,.!?;:()*—–«»…“„"\-]'
LETTER = r'[^\x09-\x0D ,.!?;:()*—–«»…“„"\-]'
#: Group 1 is the white space before a unit, group 2 the unit.
UNIT = rf"({SPACE}*+)({LETTER}++(?:[\-–—]{LETTER}++)*+|\.\.\.|{MARK})"
ANY_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def sanitize(c: Column) -> Column:
    """Drops bracketed passages, symbols, marks and invisible characters; evens out white space around punctuation."""
    # a bracket that nothing closes takes the rest of its line at once, and gives it back
    c = _sub(c, r"\[[^\]\n]*+\]|(\[[^\]\n]*+)", "$1")
    c = F.translate(c, "\u00a0", " ")
    c = _sub(c, r"[^\p{L}\p{N}\x09-\x0D \p{P}]", "")
    c = _sub(c, SPACE + "+", " ")
    c = _sub(c, r" +([.,!?;:])", "$1")
    c = _sub(c, r"([.,!?;:])([^ ])", "$1 $2")
    return F.trim(c)


def validity(clean: Column, original: Column) -> Column:
    """'empty', 'shrunk' (under half of the original is left) or 'ok'."""
    return F.when(clean == "", "empty").when((F.length(original) > 0) & (F.length(clean) < F.floor(F.length(original) / 2)), "shrunk").otherwise("ok")


def preprocess(c: Column) -> Column:
    """Collapses white space of any kind, none before punctuation."""
    c = _sub(c, ANY_SPACE + "+", " ")
    return F.trim(_sub(c, r" +([.,!?;:])", "$1"))


#: All up to the last terminator, with the quotes that belong to it: found from the end, in one pass.
_TERMINATED = r'(?s)^.*(?:[.!?][»"]*|…)'


def sentence_heads(c: Column) -> Column:
    """Terminated sentences of a sanitized text.

    The text behind the last terminator is cut off first: there the pattern would be tried
    in vain from each character to the end.
    """
    return F.regexp_extract_all(F.regexp_extract(c, _TERMINATED, 0), F.lit(rf'([^.!?…]*+(?:[.!?][.]*[»"]*|…)){SPACE}*'), F.lit(1))


def sentence_tail(c: Column) -> Column:
    """What follows the last terminator."""
    return _sub(c, rf"{_TERMINATED}{SPACE}*", "")


def join_sentences(heads: Column, tail: Column) -> Column:
    """Heads and tail, which a closing quote cuts once more; trimmed, without empty ones."""
    cut = r"(?s)^(.+»)(.*)$"
    parts = F.when(tail.rlike("(?s)^.+»"), F.array(F.regexp_extract(tail, cut, 1), F.regexp_extract(tail, cut, 2))).otherwise(F.array(tail))
    return F.filter(F.transform(F.concat(heads, parts), lambda x: F.trim(x)), lambda x: x != "")


def sentences_scan(c: Column) -> Column:
    """A cut after each . ! or ?; stripped, without empty ones."""
    parts = F.regexp_extract_all(c, F.lit(r"[^.!?]*+[.!?]|[^.!?]++"), F.lit(0))
    edge = rf"^{ANY_SPACE}+|{ANY_SPACE}+$"
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, edge, "")), lambda x: x != "")


def sentences_dots(c: Column) -> Column:
    """Cut at dots only, each part with its dot again; blank parts go."""
    edge = rf"^{ANY_SPACE}+|{ANY_SPACE}+$"
    parts = F.transform(F.split(c, r"\."), lambda x: F.regexp_replace(x, edge, ""))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(x, F.lit(".")))


def units(c: Column) -> Column:
    """The words and marks of a text, in order."""
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(2))


def unit_gaps(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(1))


def is_space(c: Column) -> Column:
    return (c == "") | c.rlike(f"^{SPACE}$")


def is_mark(c: Column) -> Column:
    return c.isin(*PUNCTUATION)


def clean_word(c: Column) -> Column:
    return _sub(c, MARK, "")


def cyrillic_lower(c: Column) -> Column:
    """Lower-cases Russian, and two Ukrainian, capitals; all else stays."""
    return F.translate(c, UPPER, LOWER)


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[Ѐ-ӿ]")


def file_size(n: Column) -> Column:
    return F.format_string("%.2f", n / F.lit(1048576.0))


def char_at(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1)


def slice_inclusive(c: Column, start: int, end: int) -> Column:
    """Code points start to end, both included; clamped."""
    return F.substring(c, start + 1, end - start + 1) if start <= end else F.lit("")


def find(c: Column, needle: str, start: int = 0) -> Column:
    """0-based place of needle at or after start, -1 if there is none; an empty needle is at start, if that is inside."""
    if needle == "":
        return F.when(F.length(c) >= start, F.lit(start)).otherwise(-1)
    return F.locate(needle, c, start + 1) - 1


def char_offsets(c: Column) -> Column:
    """Byte offset of every code point."""
    widths = F.transform(F.split(c, ""), lambda x: F.octet_length(x).cast("long"))
    return F.when(F.length(c) > 0, F.transform(running(widths), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def byte_to_char(c: Column, byte: int) -> Column:
    """Index of the first code point at or after a byte offset; the length if there is none."""
    return F.length(c) - F.size(F.filter(char_offsets(c), lambda o: o >= byte))


def symbol_bytes(c: Column) -> Column:
    return F.octet_length(c)


def lead_bytes(c: Column, i: Column) -> Column:
    """Bytes of the symbol that begins at byte i of a binary; 0 if none can begin there."""
    b = F.conv(F.hex(F.substring(c, i + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(b < 0x80, 1).when(b.between(0xC0, 0xDF), 2).when(b.between(0xE0, 0xEF), 3).when(b.between(0xF0, 0xF7), 4).otherwise(0)


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\x09-\x0D ]+")).cast("long")


def snippet(c: Column, limit: int = 90) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def snippet_line(sent_no: Column, c: Column) -> Column:
    s = snippet(c)
    return F.when(s != "", F.concat(F.lit("• Предложение №"), sent_no.cast("string"), F.lit(": "), s))


def highlight(c: Column, needle: str) -> Column:
    """Every hit of needle, whatever its case, inside <mark>."""
    if needle == "":
        return c
    literal = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", needle)
    return _sub(c, f"(?iu)({literal})", "<mark>$1</mark>")


def escape_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def base_label(c: Column) -> Column:
    return _sub(c, "^[BI]-", "")


def metric_class(c: Column) -> Column:
    """The part after the first hyphen, or the whole label."""
    return F.when(c.contains("-"), F.split_part(c, F.lit("-"), F.lit(2))).otherwise(c)


def type_name(c: Column) -> Column:
    """Russian name by containment, in a fixed order; the label itself if none fits."""
    out = c
    for key, name in reversed((("SUBJECT", "подлежащее"), ("PREDICATE", "сказуемое"), ("DEFINITION", "определение"), ("ADDITION", "дополнение"), ("ADVERBIAL", "обстоятельство"))):
        out = F.when(c.contains(key), name).otherwise(out)
    return F.when(c == "O", "другое").otherwise(out)


def role(type_ru: Column) -> Column:
    out = type_ru
    for name, short in (("подлежащее", "подл."), ("сказуемое", "сказ."), ("дополнение", "доп."), ("определение", "опр."), ("обстоятельство", "обст."), ("другое", "др.")):
        out = F.when(type_ru == name, short).otherwise(out)
    return out
