"""Text keys: folding, tokens, dictionary expansion, slugs, hashes, years and periods.

Everything is a Column expression. Folded strings are comparison keys only; the spelling that was
read is always kept beside them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: French abbreviations, replaced before accents are folded, longest first -------
FRENCH_ABBREVIATIONS = {
    "é.é.c.": "ecole elementaire catholique",
    "é.s.c.": "ecole secondaire catholique",
    "é.é.": "ecole elementaire",
    "é.s.": "ecole secondaire",
    "é.p.": "ecole publique",
}
# --- fixed values: school-name abbreviations, one per token ---------------------------------------
SCHOOL_WORDS = {
    "ss": "secondary school",
    "css": "catholic secondary school",
    "chs": "catholic high school",
    "hs": "high school",
    "ps": "public school",
    "es": "elementary school",
    "ces": "catholic elementary school",
    "ci": "collegiate institute",
    "cvi": "collegiate and vocational institute",
    "sec": "secondary",
    "elem": "elementary",
    "cath": "catholic",
    "pub": "public",
    "st": "saint",
    "ste": "sainte",
    "sr": "senior",
    "jr": "junior",
    "eec": "ecole elementaire catholique",
    "esc": "ecole secondaire catholique",
}
# --- fixed values: organisation-name abbreviations, one per token ---------------------------------
BOARD_WORDS = {
    "dsb": "district school board",
    "cdsb": "catholic district school board",
    "dcsb": "district catholic school board",
    "csb": "catholic school board",
    "sb": "school board",
    "sa": "school authority",
    "cs": "conseil scolaire",
    "csd": "conseil scolaire de district",
    "csdc": "conseil scolaire de district catholique",
    "cep": "conseil des ecoles publiques",
}
BOARD_STOP_WORDS = ("of", "the", "and", "de", "du", "des", "la", "le", "et")
# --- fixed values: street words, long form to short form ------------------------------------------
STREET_WORDS = {
    "street": "st",
    "avenue": "ave",
    "road": "rd",
    "drive": "dr",
    "boulevard": "blvd",
    "crescent": "cres",
    "court": "crt",
    "place": "pl",
    "lane": "ln",
    "highway": "hwy",
    "parkway": "pkwy",
    "terrace": "terr",
    "square": "sq",
    "circle": "cir",
    "trail": "trl",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
}
# --- fixed values: accent table used by list filters ----------------------------------------------
FILTER_ACCENTS = "àâäáãéèêëíìîïóòôöõúùûüçñ’"
FILTER_PLAIN = "aaaaaeeeeiiiiooooouuuucn'"

# runs of whitespace other than a lone space, which may stay as it is
_BLANKS = r"(?U)(?: [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*)"


def _ranges(codes: list[int]) -> str:
    """A regular-expression class of code points, neighbours joined."""
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != c + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, str, str]:
    """(from, to) for translate, the table of characters that expand to several, and a pattern of these.

    Derived from the whole Unicode database: compatibility decomposition without combining marks.
    Marks themselves are deleted, which translate does for a source without a counterpart. Hangul
    syllables are left to arithmetic.
    """
    source, target, deleted, expanded, several = [], [], [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        if HANGUL <= code < HANGUL + 11172 or char == (full := unicodedata.normalize("NFKD", char)) and not unicodedata.combining(char):
            continue
        plain = "".join(c for c in full if not unicodedata.combining(c))
        if plain == "":
            deleted.append(char)
        elif len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            several.append(code)
            expanded.append(f"\x01{char}\x02{plain}")
    pattern = f"[{_ranges(several)}\\x{{{HANGUL:X}}}-\\x{{{HANGUL + 11171:X}}}]"
    return "".join(source + deleted), "".join(target), "".join(expanded) + "\x01", pattern


# Hangul syllables decompose by arithmetic over 19 leading, 21 middle and 28 closing parts (Unicode, section 3.12)
HANGUL = 0xAC00
LEADING, MIDDLE, CLOSING = ("".join(map(chr, range(start, start + n))) for start, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def clean_text(value: Column) -> Column:
    """Collapse whitespace and trim; blank becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(value, _BLANKS, " ")), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(value: Column) -> Column:
    """Lower case without accents, whitespace collapsed; NULL becomes the empty string."""
    source, target, expanded, pattern = _folding_tables()

    def is_ascii(text: Column) -> Column:
        return ~text.rlike(r"[^\x00-\x7f]")

    def letter(c: Column) -> Column:
        at = F.instr(F.lit(expanded), F.concat(F.lit("\x01"), c, F.lit("\x02")))
        number = F.ascii(c) - HANGUL
        parts = [(LEADING, F.floor(number / 588)), (MIDDLE, F.floor(number % 588 / 28)), (CLOSING, number % 28 - 1)]
        syllable = F.concat(*[F.when(k >= 0, F.substr(F.lit(x), (k + 1).cast("int"), F.lit(1))).otherwise("") for x, k in parts])
        return F.when(at > 0, F.substring_index(F.substr(F.lit(expanded), at + 3), "\x01", 1)).when(number.between(0, 11171), syllable).otherwise(c)

    def spelled(text: Column) -> Column:
        # few texts hold characters that expand
        return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, ""), letter), "")).otherwise(text)

    def plain(text: Column) -> Column:
        # most texts are ASCII at once
        return F.when(is_ascii(text), text).otherwise(let(F.translate(text, source, target), spelled))

    folded = let(F.coalesce(value.cast("string"), F.lit("")), plain)
    return F.lower(F.trim(F.regexp_replace(folded, _BLANKS, " ")))


def tokens(folded: Column) -> Column:
    """Words of a folded text; apostrophes and periods vanish, other signs separate."""
    text = F.replace(folded, F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, "['’`.]", "")
    return F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def expand(words: Column, table: Mapping[str, str]) -> Column:
    """Replace each word by its dictionary entry and join with spaces."""
    lookup = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(lookup, w), w)), " ")


def normalize_header(value: Column) -> Column:
    return F.array_join(tokens(fold(value)), " ")


def normalize_school_name(value: Column) -> Column:
    text = F.lower(F.coalesce(value, F.lit("")))
    for short, full in FRENCH_ABBREVIATIONS.items():
        text = F.replace(text, F.lit(short), F.lit(f" {full} "))
    return expand(tokens(fold(text)), SCHOOL_WORDS)


def normalize_org_name(value: Column) -> Column:
    return expand(tokens(fold(value)), BOARD_WORDS)


def board_key(value: Column) -> Column:
    """Organisation key that ignores word order and filler words."""
    words = F.filter(F.split(normalize_org_name(value), " "), lambda w: (w != "") & ~w.isin(*BOARD_STOP_WORDS))
    return F.array_join(F.array_sort(words), " ")


def normalize_address(value: Column) -> Column:
    return expand(tokens(fold(value)), STREET_WORDS)


def normalize_postal_code(value: Column) -> Column:
    """A9A9A9 in capitals, or NULL."""
    compact = F.upper(F.regexp_replace(fold(value), "[^A-Za-z0-9]", ""))
    return let(compact, lambda c: F.when(c.rlike("^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$"), c))


def postal_code_or_text(value: Column) -> Column:
    return F.coalesce(normalize_postal_code(value), clean_text(value))


def slugify(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*[tokens(fold(p)) for p in parts])), "-")


def stable_hash(*parts: Column) -> Column:
    """sha256 of the pipe-joined parts; a NULL part counts as the empty string."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def normalize_school_level(value: Column) -> Column:
    def level(words: Column) -> Column:
        elementary = F.arrays_overlap(words, F.array(*map(F.lit, ("elem", "elementary", "elementaire"))))
        secondary = F.arrays_overlap(words, F.array(*map(F.lit, ("sec", "secondary", "secondaire"))))
        return F.when(elementary & secondary, "combined").when(elementary, "elementary").when(secondary, "secondary")

    return let(tokens(fold(value)), level)


def operation_category(value: Column) -> Column:
    def category(label: Column) -> Column:
        return (
            F.when(label.isin("school", "schools", "ecole", "k-12 school"), "school")
            .when(label.rlike("admin|office|bureau"), "administrative")
            .otherwise("other")
        )

    # the usual spellings need no folding
    return F.when(F.lower(value).isin("school", "k-12 school"), "school").otherwise(let(fold(value), category))


def filter_fold(value: Column) -> Column:
    """Fixed-table accent folding used by list filters."""
    return F.translate(F.lower(value), FILTER_ACCENTS, FILTER_PLAIN)


def normalize_query(value: Column) -> Column:
    """Search key: periods separate words here, apostrophes vanish."""
    text = F.regexp_replace(fold(value), "['’`]", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def year_in(value: Column) -> Column:
    """The one distinct 20xx year in a text, else NULL."""
    years = F.array_distinct(F.regexp_extract_all(value, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)))
    return let(years, lambda y: F.when(F.size(y) == 1, F.try_element_at(y, F.lit(1)).cast("int")))


def parse_year(value: Column, file_year: Column) -> Column:
    """An integral number, else the year in the text; zero and NULL fall back to the file's year."""
    from peerscope.functions.units import to_float

    number = to_float(value)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e9), number.cast("int"))
    return F.coalesce(F.nullif(F.coalesce(whole, year_in(clean_text(value))), F.lit(0)), file_year)


def reporting_period(year_ending: Column) -> Column:
    """STRUCT(start, end): the twelve months that end on the given day."""
    text = clean_text(year_ending)
    end = F.coalesce(text.try_cast("timestamp").cast("date"), F.try_to_date(text, "M/d/yyyy"))
    return F.struct(F.date_add(F.add_months(end, -12), 1).alias("start"), end.alias("end"))


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    def found(value: Column) -> Column:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(value, F.lit(marker))
        return hit

    return let(text, found)
