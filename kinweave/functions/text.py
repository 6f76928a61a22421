"""Text normalisation as column expressions: all of it runs in generated JVM code, no row passes through Python."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACES = r"[ \t\r\n\"']"


@lru_cache(maxsize=1)
def _latin_letters() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition is another single letter, those, and letters that stand for several.

    Made from Python's Unicode tables: whatever is of the Latin script loses its marks; ligatures, full-width forms, ordinal
    signs and Roman numerals become plain.
    """
    one, to, several = [], [], {}
    latin = regex.compile(r"\p{Script=Latin}")
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if not latin.match(c):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if plain == c or not plain:
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        else:
            several[c] = plain
    return "".join(one), "".join(to), several


def without_joiners(text: Column) -> Column:
    """Without zero-width joiners and non-joiners."""
    return F.translate(text, "‌‍", "")


def fold_latin(text: Column) -> Column:
    """Latin letters without accents, ligatures spelt out; marks on other scripts' letters stay. ASCII texts are left at once."""
    one, to, several = _latin_letters()
    folded = F.translate(text, one, to)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    folded = F.when(text.rlike("[" + "".join(several) + "]"), spelt).otherwise(folded)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"(\p{IsLatin})\p{M}+", "$1")).otherwise(text)


def clean_words(text: Column) -> Column:
    """Folded, lower case, with each run of anything but letters, marks and numbers one space."""
    return F.trim(F.regexp_replace(F.lower(fold_latin(text)), r"[^\p{L}\p{M}\p{N}]+", " "))


def words(text: Column) -> Column:
    """The words of a clean text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def latin_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits once letters are folded and all else that isn't ASCII is gone."""
    return F.regexp_extract_all(F.regexp_replace(fold_latin(F.lower(text)), r"[^\x00-\x7F]", ""), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of word characters of any script."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[\wऀ-ൿ]+"), F.lit(0))


def native_tokens(text: Column) -> Column:
    """Tokens with a character of an Indic script."""
    return F.filter(tokens(text), lambda t: t.rlike(r"[ऀ-ൿ]"))


def unknown_native(text: Column, dictionary: Column) -> Column:
    """How many native tokens a map column doesn't have."""
    return F.size(F.filter(native_tokens(text), lambda t: ~F.map_contains_key(dictionary, t)))


def substitute(text: Column, dictionary: Column) -> Column:
    """Each token as the dictionary has it, if it does, with what stands between tokens as it is."""
    # Cut before and after every token: what results are tokens and what stands between, which no dictionary holds.
    parts = F.split(text, r"(?U)(?<=[\wऀ-ൿ])(?![\wऀ-ൿ])|(?<![\wऀ-ൿ])(?=[\wऀ-ൿ])")
    return F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(dictionary, t), t)), "")


def after_alias(text: Column) -> Column:
    """What follows the first 'doing business as' or the like, once."""
    return F.regexp_replace(text, fixed.ALIAS_MARKER, "")


def before_bar(text: Column) -> Column:
    return F.substring_index(text, " | ", 1)


def without_web_parts(text: Column) -> Column:
    """Leading @ and #, www. and common domain endings as spaces."""
    return F.regexp_replace(text, fixed.WEB_PARTS, " ")


def rejoin_forms(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\bl l c\b", "llc"), r"\bl l p\b", "llp")


def name_full(raw: Column, dictionary: Column | None = None) -> Column:
    """A name's normal form; null is empty."""
    text = without_joiners(F.coalesce(raw, F.lit("")))
    if dictionary is not None:
        text = substitute(text, dictionary)
    return rejoin_forms(clean_words(without_web_parts(before_bar(after_alias(text)))))


def name_core(full: Column) -> Column:
    """A normal name without legal forms, or all of it if nothing else is left."""
    core = F.array_join(F.filter(F.split(full, " "), lambda w: ~w.isin(fixed.LEGAL_FORMS)), " ")
    return F.when(core == "", full).otherwise(core)


def mapped(key: Column, table: dict[str, str], default: Column) -> Column:
    """A small table's value for a key, as a chain of comparisons that stays in generated code."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), default)


def _comma_parts(raw: Column) -> Column:
    return F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.regexp_replace(p, f"^{SPACES}+|{SPACES}+$", ""))


def _states() -> dict[str, str]:
    return {s.lower(): s for s in fixed.STATES} | fixed.STATE_ALIASES


def address_clean(raw: Column, block: Column, learned: Column | None = None) -> Column:
    """An address's normal form: states and regions by name or code, street words by country, without the word null.

    block names the country: India, France, US, or any other. learned is a map of native spellings to states.
    """

    def india(p: Column) -> Column:
        low = F.lower(p)
        known = mapped(low, _states(), mapped(low, fixed.STATE_CODES, p))
        return known if learned is None else F.coalesce(F.try_element_at(learned, p), known)

    parts = F.transform(_comma_parts(raw), without_joiners)
    parts = (
        F.when(block == "India", F.transform(parts, india))
        .when(block == "France", F.transform(parts, lambda p: mapped(F.lower(p), fixed.FRENCH_REGIONS, p)))
        .when(block == "US", F.transform(parts, lambda p: mapped(F.lower(p), fixed.US_STATES, p)))
        .otherwise(parts)
    )
    each = F.split(clean_words(F.array_join(parts, ", ")), " ")
    each = F.when(block == "France", F.transform(each, lambda w: mapped(w, fixed.FRENCH_STREET_WORDS, w))).otherwise(F.transform(each, lambda w: mapped(w, fixed.STREET_WORDS, w)))
    return F.array_join(F.filter(each, lambda w: w != "null"), " ")


def state_mask(raw: Column) -> Column:
    """Bits of the states that parts of an address name."""
    bits = {name: 1 << fixed.STATES.index(state) for name, state in _states().items()}
    table = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    found = F.transform(_comma_parts(raw), lambda p: F.coalesce(F.try_element_at(table, F.replace(F.lower(p), F.lit("&"), F.lit("and"))), F.lit(0)).cast("long"))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def script_mask(raw: Column) -> Column:
    """A bit for each Indic script that a text has a character of, in the order of the scripts' blocks."""
    terms = [F.when(F.coalesce(raw, F.lit("")).rlike(f"[\\u{0x900 + 128 * i:04x}-\\u{0x97F + 128 * i:04x}]"), 1 << i).otherwise(0) for i in range(len(fixed.SCRIPT_STATES))]
    return sum(terms[1:], terms[0]).cast("int")


def allowed_states(mask: Column) -> Column:
    """Bits of the states where any of the scripts in a mask is at home; 0 if there is none."""
    out = F.lit(0).cast("long")
    for i, states in enumerate(fixed.SCRIPT_STATES.values()):
        bits = sum(1 << fixed.STATES.index(s) for s in states)
        out = out.bitwiseOR(F.when(mask.bitwiseAND(1 << i) != 0, F.lit(bits).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def pair_text(name: Column, address: Column, chars: int = fixed.PAIR_TEXT_CHARS) -> Column:
    return F.substring(F.concat(F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit(""))), 1, chars)


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def initials(text: Column) -> Column:
    return F.array_join(F.transform(words(text), lambda w: F.substring(w, 1, 1)), "")


def without_zeros(number: Column) -> Column:
    """Without leading zeros; zero itself stays."""
    rest = F.regexp_replace(number, "^0+", "")
    return F.when(rest == "", F.lit("0")).otherwise(rest)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of other scripts as ASCII ones."""
    points = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
    return F.translate(text, "".join(map(chr, points)), "".join(str(unicodedata.digit(chr(c))) for c in points))


def numbers(raw: Column) -> Column:
    """All numbers of fewer than 20 digits in order, without leading zeros."""
    found = F.regexp_extract_all(ascii_digits(F.coalesce(raw, F.lit(""))), F.lit(r"\d+"), F.lit(0))
    return F.transform(F.filter(found, lambda n: F.length(n) < 20), without_zeros)


def house(raw: Column) -> Column:
    """The first number of an address once unit and floor phrases are gone; null if none."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), fixed.UNIT_PHRASE, " "), fixed.FLOOR_PHRASE, " ")
    first = F.regexp_extract(rest, r"(\d+)", 1)
    return F.when(first != "", without_zeros(first))


def units(raw: Column) -> Column:
    """The numbers of unit and floor phrases, each once, without leading zeros (zero is the empty text)."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    phrases = F.concat(F.regexp_extract_all(low, F.lit(fixed.UNIT_PHRASE), F.lit(0)), F.regexp_extract_all(low, F.lit(fixed.FLOOR_PHRASE), F.lit(0)))
    return F.array_distinct(F.transform(phrases, lambda p: F.regexp_replace(F.regexp_extract(p, r"(\d+)\D*$", 1), "^0+", "")))


def premises(raw: Column) -> Column:
    """Numbers with letters, each once, without hyphens and slashes; ordinals are none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(fixed.PREMISE), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(p, "[-/]", "")), lambda p: ~p.rlike(fixed.ORDINAL)))


def number_set(raw: Column) -> Column:
    """All numbers of an address, each once, without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(r"\d+"), F.lit(0)), without_zeros))


def trigrams(text: Column) -> Column:
    """The three-letter windows of each word with a space at both ends; a word of n letters has n."""
    spaced = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(spaced, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))))
