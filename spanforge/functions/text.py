"""Text columns: folding, keys, names, snippets, formats. All native expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that are one letter plus marks, and that letter; the signs for kelvin and angstrom are such letters, the long s is none."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B):
        parts = unicodedata.normalize("NFD", chr(code))
        rest = [c for c in parts if not unicodedata.combining(c)]
        if len(rest) == 1 and rest[0] != chr(code):
            pairs.append((chr(code), rest[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
MARKS = "".join(c for c in map(chr, range(0x300, 0xE01F0)) if unicodedata.category(c)[0] == "M")
# fixed values
CURLY, STRAIGHT = "‘’‚“”„–—", "'''\"\"\"--"
INVISIBLE = "\u00a0\u2007\u202f\u2060\ufeff\u200b\u200c\u200d"
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "lp", "ltd", "limited", "plc", "group", "usa", "holdings")
PLACE_SUFFIXES = ("city", "town", "township", "village", "borough", "county")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def straight(text: Column) -> Column:
    """Curly quotes and dashes made plain."""
    return F.translate(text, CURLY, STRAIGHT)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_key(text: Column) -> Column:
    """A name's key: folded, lower case, without the article, letters and digits only."""
    # marks that stand beside their letter go; Java's \b knows letters outside ASCII, which are no letters of a key
    plain = F.regexp_replace(F.lower(F.translate(text, CURLY + ACCENTED + MARKS, STRAIGHT + PLAIN)), r"(?<![a-z0-9_])the(?![a-z0-9_])", " ")
    # runs of anything else are one blank already
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def search_fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9 ]", " ")


def company_key(text: Column, legal_words: tuple[str, ...] = LEGAL_WORDS) -> Column:
    """A company's key: folded, lower case, legal words removed, ``&`` and ``!`` kept."""
    plain = F.rtrim(F.lower(fold_accents(text)), F.lit("."))
    plain = F.regexp_replace(plain, rf"\b({'|'.join(legal_words)})\b", " ")
    return squeeze(F.regexp_replace(plain, "[^a-z0-9&! ]", " "))


def without_tokens(text: Column, tokens: tuple[str, ...]) -> Column:
    """Words of ``tokens`` dropped wherever they stand, then every "and" at the end."""
    kept = F.array_join(F.filter(F.split(squeeze(text), " "), lambda t: ~t.isin(*tokens)), " ")
    return F.regexp_replace(kept, r"(?:(?:^|\s+)and)+$", "")


def employer_key(text: Column, tokens: tuple[str, ...] = LEGAL_WORDS) -> Column:
    """An employer's name for comparison: lower case, ``&`` as a word, "doing business as" a mere break, legal words dropped."""
    spoken = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"\bd/?b/?a\b", " ")
    return without_tokens(F.regexp_replace(spoken, "[^a-z0-9]+", " "), tokens)


def zip5(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{5}"), F.substring(text, 1, 5))


def composed(text: Column) -> Column:
    """Unicode's canonical composition (NFC). Texts below the first combining mark are composed as they are and stay in the JVM."""

    @F.arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(compose(F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), text)), text)


def normal_text(text: Column) -> Column:
    """Composed, invisible signs blank, line ends \\n, no trailing blanks, two line ends at most, no white space at the ends."""
    text = F.translate(composed(text), INVISIBLE, " " * len(INVISIBLE))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def snippet(text: Column, needle: Column, width: int) -> Column:
    """``width`` characters around the needle's first occurrence, with an ellipsis where cut; the beginning if it does not occur."""
    at = F.position(needle, text)
    begin = F.greatest(F.lit(1), at - F.lit(width // 2)).cast("int")
    body = F.substring(text, begin, F.lit(width))
    left = F.when(begin > 1, F.lit("…")).otherwise("")
    right = F.when(begin + width - 1 < F.length(text), F.lit("…")).otherwise("")
    return F.concat(left, body, right)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def name_list(names: Column) -> Column:
    """"A", "A and B", "A, B and C"."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, names[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def compact_money(amount: Column) -> Column:
    """$1.2B, $3.4M, $5K, $67; half up."""
    size = F.abs(amount)

    def scaled(by: float, digits: int, unit: str) -> Column:
        return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", F.round(amount / by, digits)), F.lit(unit))

    return F.when(size >= 1e9, scaled(1e9, 1, "B")).when(size >= 1e6, scaled(1e6, 1, "M")).when(size >= 1e3, scaled(1e3, 0, "K")).otherwise(scaled(1, 0, ""))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(share * 100, digits)), F.lit("%"))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def host(url: Column) -> Column:
    """Host name of a URL, null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), F.lit(""))


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def packed_parts(name: Column, least: int = 6) -> Column:
    """Names packed into one: the whole, then its parts at commas, semicolons and spaced slashes that are long enough."""
    parts = F.filter(F.transform(F.split(name, r"[,;]| / "), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
    return F.array_distinct(F.concat(F.array(name), parts))


def strict_parts(name: Column, words: tuple[str, ...], least: int = 6) -> Column:
    """Parts only if each has two to six words, is long enough and has one of ``words``; none with parentheses."""
    parts = F.transform(F.split(name, r"[,;]| / "), lambda p: F.trim(p))
    pattern = rf"(?i)\b({'|'.join(words)})\b"
    good = F.forall(parts, lambda p: (F.size(F.split(p, r"\s+")).between(2, 6)) & (F.length(p) >= least) & p.rlike(pattern))
    return F.when((F.size(parts) > 1) & ~name.contains("(") & good, parts).otherwise(F.array().cast("array<string>"))


def short_forms(name: Column, city: Column | None = None, least: int = 6) -> Column:
    """Shorter ways to write a name: without its place, its trailing city, a person's first names, or "Center" after one word."""
    forms = [F.regexp_replace(name, r"\s+(at|in|of|on)\s+.*$", ""), F.regexp_replace(name, r"^[A-Z][a-z]+\s+[A-Z]\.\s+", ""), F.regexp_extract(name, r"^(\S+ Center)\b", 1)]
    if city is not None:
        forms.append(F.when(name.endswith(F.concat(F.lit(" "), city)), F.substring(name, F.lit(1), F.length(name) - F.length(city) - 1)).otherwise(name))
    return F.array_distinct(F.filter(F.array(*forms), lambda f: (F.length(f) >= least) & (f != name)))


def rewritten_forms(name: Column, rules: list[tuple[str, str]], rounds: int = 6) -> Column:
    """All names met while the rewrite rules are applied until nothing changes."""
    forms, now = [name], name
    for _ in range(rounds):
        for pattern, new in rules:
            now = squeeze(F.regexp_replace(now, pattern, new))
        forms.append(now)
    return F.array_distinct(F.array(*forms))


def without_place_suffix(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?i)\s+({'|'.join(PLACE_SUFFIXES)})$", "")


def expanded(word: Column, shorthand: dict[str, str]) -> Column:
    """A known shorthand's full form, else the word."""
    pairs = [F.lit(x) for item in shorthand.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), word), word)


def has_run(text: Column, alias: Column) -> Column:
    """Whether ``alias`` occurs as whole words in ``text`` (both single-blank separated)."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), alias, F.lit(" ")))
