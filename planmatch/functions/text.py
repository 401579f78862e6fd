"""Labels and identifiers: normalisation, shapes, and the grammar of pole labels.

White space is what Unicode calls white space, and digits include superscripts and circled digits: the JVM's ``\\s`` and
``\\d`` know neither.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)
LETTER = r"\p{L}"
#: The characters of WS.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# They decide results and are stated as the domain has them.
WRAPPERS = " \t\r\n.,;:!?()[]{}<>\"'`"
SEPARATORS = "-#:.,/"
UNKNOWN = ["UNK", "UNKN", "UNKNOWN", "TBD", "NA", "N/A", "NONE", "?", "??", "???"]
UNKNOWN_PREFIXES = ["PP-", "PP#", "PP", "P-", "P#", "POLE#", "POLE", "P"]
#: Penalties in ten-thousandths, so that sums and margins are exact.
PENALTY = {
    "removed_ocr_plan_prefix": 200,
    "removed_pole_number_prefix": 200,
    "removed_generic_plan_prefix": 400,
    "removed_unspaced_plan_prefix": 600,
    "model_confirmed_explicit_pole_context": 500,
    "added_terminal_f": 1500,
    "removed_terminal_f": 1500,
}
#: Leading digit, look-alike letter, penalty in ten-thousandths; in order of preference.
LOOKALIKES = [
    ("0", "O", 300), ("0", "D", 1800), ("0", "Q", 2200),
    ("1", "I", 800), ("1", "L", 1600), ("1", "J", 2000),
    ("2", "Z", 2400), ("4", "A", 2000), ("5", "S", 1000), ("6", "G", 1000), ("6", "C", 2200), ("7", "T", 2200), ("8", "B", 2000), ("9", "G", 2400),
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space at either end."""
    # most ends are blanks or visible characters of ASCII, which need no long class
    t = F.btrim(col(c), F.lit(" "))
    return F.when(t.rlike("^[^!-~]|[^!-~]$"), F.regexp_replace(t, rf"^{WS}+|{WS}+$", "")).otherwise(t)


def normalized(c: Column | str) -> Column:
    """Upper case, all white space deleted."""
    t = F.translate(F.upper(col(c)), " ", "")
    return F.when(t.rlike("[^!-~]"), F.regexp_replace(t, WS, "")).otherwise(t)


def shape(c: Column | str) -> Column:
    """Letters as A, digits as 9, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(col(c), LETTER, "A"), DIGIT, "9")


def unwrapped(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WRAPPERS))


def without_separators(c: Column | str) -> Column:
    return F.translate(col(c), SEPARATORS, "")


def left_stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\-#:.,/]+", "")


def letter_and_digit(c: Column | str) -> Column:
    """The long class of digits is searched in texts beyond ASCII only."""
    c = col(c)
    digit = c.rlike("[0-9]") | c.rlike(r"[^\x00-\x7F]") & c.rlike(DIGIT)
    return digit & c.rlike(LETTER)


def unknown_body(c: Column | str) -> Column:
    """The token by which a label says that its pole isn't known, or null."""
    c = col(c)
    body = c
    for prefix in reversed(UNKNOWN_PREFIXES):
        body = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(body)
    body = left_stripped(body)
    return F.when(body.isin(UNKNOWN), body)


def _part(body: Column, name: str) -> Column:
    return F.struct(body.alias("body"), F.lit(name).alias("name"), F.lit(PENALTY[name]).alias("penalty"))


def plan_prefix(c: Column | str, letters: Column) -> Column:
    """Struct body, name, penalty of a label without its marker, or null; the surest reading first.

    ``letters``: the letters that begin catalog ids, which a marker written flush against digits must not have.
    """
    c = col(c)
    # the dot stands for all but a line feed: a normalised text has none
    known = r"^(?:P-|P#|PP#|POLE-?NO:?|POLE#?:?)(.+)$"
    separated = r"^[A-Z]{1,4}[\-#:.,/]+([A-Z0-9]+)$"
    flush = r"^([A-Z]{1,2})(\p{Nd}[A-Z0-9]*)$"
    marker = F.regexp_extract(c, flush, 1)
    return (
        F.when(c.startswith("PP-"), _part(F.substring(c, 4, 2**31 - 1), "removed_ocr_plan_prefix"))
        .when(c.rlike(known), _part(left_stripped(F.regexp_extract(c, known, 1)), "removed_pole_number_prefix"))
        .when(c.rlike(separated) & F.regexp_extract(c, separated, 1).rlike("[0-9]"), _part(F.regexp_extract(c, separated, 1), "removed_generic_plan_prefix"))
        .when(c.rlike(flush) & ~F.arrays_overlap(F.split(marker, ""), letters), _part(F.regexp_extract(c, flush, 2), "removed_unspaced_plan_prefix"))
    )


def lookalike_name(digit: str, letter: str) -> str:
    return "leading_zero_to_letter_o" if (digit, letter) == ("0", "O") else f"leading_digit_{digit}_to_letter_{letter.lower()}"


def explicit_label(c: Column | str) -> Column:
    """Whether the label itself says that it is a pole's."""
    return normalized(c).rlike(r"^(?:P#|PP-|POLE(?:#|:|NO\.?|NUMBER))")


def readable(c: Column | str) -> Column:
    """Whether a normalised text can be an identifier at all."""
    return F.length(col(c)).between(1, 32) & col(c).rlike(rf"{LETTER}|{DIGIT}|\p{{N}}")


def owner(c: Column | str) -> Column:
    return F.when(F.upper(trimmed(c)).endswith("F"), "Foreign").otherwise("City")


def single_line(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(col(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", " "))
