"""Text functions as expressions of built-in functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that become spaces, ASCII punctuation, and the marker that ends a response.
DASHES = ("–", "—", "−", "-")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MARKER = "###"
SECTIONS = ("Motif d'hospitalisation", "Condition principal d'admission", "Antécédent", "Mode de vie", "Histoire de la maladie", "Examen clinique", "Examens complémentaires", "Évolution pendant l'hospitalisation", "Conclusion")


def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has one ASCII character, what that is, and those with more."""
    one, to, more = [], [], {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(point))
            to.append(plain)
        elif plain:
            more[chr(point)] = plain
    return "".join(one), "".join(to), more


_ONE, _TO, _MORE = _folding()
_LONGER = "".join(_MORE)
#: All of ``_LONGER`` and others, in few ranges: what most texts don't have.
_PERHAPS_LONGER = "[\u00bc-\u00be\u0132\u0133\u01c4-\u01f3\u2025-\U0010ffff]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _spelled_out(text: Column) -> Column:
    """Texts with characters that stand for several ASCII ones (…, ™, ½, ㎏) have those instead; others stay as they are."""
    has = text.rlike(_PERHAPS_LONGER) & (F.length(F.translate(text, _LONGER, "")) < F.length(text))
    plain = F.str_to_map(F.lit("\u0001".join(f"{c}\u0002{p}" for c, p in _MORE.items())), F.lit("\u0001"), F.lit("\u0002"))  # folded to a constant
    parts = F.split(text, f"(?<=[{_LONGER}])|(?=[{_LONGER}])")
    return F.when(has, F.array_join(F.transform(parts, lambda x: F.coalesce(F.when(F.length(x) == 1, plain[x]), x)), "")).otherwise(text)


def remove_accents(c: Column | str) -> Column:
    """The ASCII characters of a text's compatibility decomposition: letters without accents, "kg" for ㎏; what has none is dropped (so are œ and ß). ASCII texts stay as they are."""
    text = _col(c)
    folded = F.regexp_replace(F.translate(_spelled_out(text), _ONE, _TO), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def remove_symbols(c: Column | str) -> Column:
    """Keeps letters and digits of any script, underscores and white space."""
    return F.regexp_replace(_col(c), r"(?U)[^\w\s]", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def _normal_characters(text: Column, kept: str = "") -> Column:
    """What ``normalize_text`` makes of each character, spaces not yet collapsed; the characters ``kept`` stay."""
    for dash in DASHES:
        text = F.replace(text, F.lit(dash), F.lit(" "))
    text = F.regexp_replace(remove_accents(text), rf"[^\x20-\x7E{kept}]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[0-9]+", ""), PUNCTUATION, " "))


def normalize_text(c: Column | str) -> Column:
    """Dashes become spaces, accents go, control characters and digits are deleted, punctuation becomes spaces; lower case, single spaces."""
    return collapse_spaces(_normal_characters(_col(c)))


def normalize_tokens(c: Column | str) -> Column:
    """The normalised tokens of an array, as one text that is normalised once; tokens without letters are empty."""
    mark = "\u0001"
    tokens = F.transform(_col(c), lambda t: F.replace(t, F.lit(mark), F.lit("")))
    text = F.regexp_replace(_normal_characters(F.array_join(tokens, mark, ""), mark), r"\s+", " ")
    return F.split(F.trim(F.regexp_replace(text, f" ?{mark} ?", mark)), mark)


def newline_to_space(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def cut_at_marker(c: Column | str, marker: str = MARKER) -> Column:
    """What stands before the first marker, stripped; texts without one as they are."""
    text = _col(c)
    return F.when(F.contains(text, F.lit(marker)), strip(F.split_part(text, F.lit(marker), F.lit(1)))).otherwise(text)


def split_words(c: Column | str) -> Column:
    """The non-empty parts between white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"\s+"), lambda x: x != "")


def split_list(c: Column | str, separator: str = ", ") -> Column:
    return F.split(_col(c), separator, -1)


def code_prefix(c: Column | str, n: int = 3) -> Column:
    return F.lower(F.substring(_col(c), 1, n))


def parse_literal_list(c: Column | str) -> Column:
    """The strings in a list literal; an empty array for anything else."""
    text = F.when(F.trim(_col(c)).startswith("["), _col(c))
    return F.coalesce(F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def ordered_distinct(c: Column | str, separator: str = ", ") -> Column:
    """The distinct items of an array in the order of their first occurrence, joined."""
    return F.array_join(F.array_distinct(_col(c)), separator)


def slug(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("/"), F.lit("-"))


def base_name(c: Column | str) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(_col(c), r"([^/]*)$", 1), r"\.[^.]*$", "")


def in_section_order(c: Column | str, sections: tuple[str, ...] = SECTIONS) -> Column:
    """Whether all section titles occur in their order, across lines."""
    quoted = [r"\Q" + s + r"\E" for s in sections]
    return F.coalesce(_col(c).rlike("(?s)" + ".*?".join(quoted)), F.lit(False))


def bleu_tokens(c: Column | str) -> Column:
    """Lower-cased words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


def letter_words(c: Column | str) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
