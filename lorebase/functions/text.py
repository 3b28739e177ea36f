"""Column functions over section numbers, titles, markup and prose."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIGITS, MAX_LETTERS = 6, 4
#: Fixed words that make a note an amendment, and notes that make a section an omitted one.
AMENDMENT_HINT = r"(?i)\b(?:Ins\.|Subs\.|Rep\.|Omitted|Substituted|Inserted|w\.e\.f\.|vide\b|Act\s+\d+\s+of\s+\d{4})"
OMITTED_NOTES = ("repealed", "omitted")
#: What begins an omitted section's text: the old title in brackets, and the word. `Rep.` counts with any character behind.
OMITTED_BODY = r"(?i)^\[[^\]]*\]\s*(?:Rep\.|Repealed\b|Omitted\b)"
LEADING_MARKERS = r"^(?:\s*\[[0-9]{1,2}\])+\s*"
#: What begins a footnote, and a segment's number.
FOOTNOTE_START = r"(?m)^\s*\[?([0-9]{1,2})\]?\s*\.\s*"
#: Fixed value: what begins a segment at a line's start; any word Provided begins one too.
SEGMENT_START = r"(?m)^(\s*)(\(\s*[0-9]{1,2}[A-Za-z]?\s*\)|(?:Explanation|Illustrations?|Exception)\b)"
_SEGMENT_CUT = rf"(?m)(?={SEGMENT_START.removeprefix('(?m)')}|\bProvided\b)"
SEGMENT_NUMBER = r"^\(\s*([0-9]{1,2}[A-Za-z]?)\s*\)"
#: Common English words that no search looks for.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)
_REFERENCE = "&(?:#[0-9]{1,18};?|#[xX][0-9a-fA-F]{1,15};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: The names that pages use most are told first; a map is searched from its beginning.
_USUAL = ("amp", "lt", "gt", "quot", "nbsp", "apos", "mdash", "ndash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo", "copy", "eacute", "egrave")


def _reference_names() -> str:
    """JSON of every named reference, and of the numbers 128 to 159, which mean what Windows-1252 has there."""
    names = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")}
    for n in range(128, 160):
        try:
            names[f"&#{n};"] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return json.dumps(names)


def _once(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def decode_references(text: Column) -> Column:
    """Character references, named and numeric, as their characters; unknown names stay, impossible numbers give U+FFFD.

    The semicolon may be missing after a number and after the old names that HTML allows
    without it, which count wherever they begin a name: `&copy2020` is a sign and a year.
    """
    names = F.from_json(F.lit(_reference_names()), "map<string,string>")
    old = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    begins = f"^&({'|'.join(old)})"

    def named(x: Column) -> Column:
        first, *rest = _USUAL
        usual = F.when(x == f"&{first};", html.entities.html5[f"{first};"])
        for k in rest:
            usual = usual.when(x == f"&{k};", html.entities.html5[f"{k};"])
        prefix = F.regexp_extract(x, begins, 1)
        cut = F.concat(F.try_element_at(names, F.concat(F.lit("&"), prefix, F.lit(";"))), F.substring(x, F.length(prefix) + 2, F.length(x)))
        return usual.otherwise(F.coalesce(F.try_element_at(names, x), F.when(prefix != "", cut), x))

    def numeric(x: Column) -> Column:
        digits = F.regexp_extract(x, "#[xX]?([0-9a-fA-F]+)", 1)
        n = F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        possible = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        char = F.when(possible, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(n.between(128, 159), F.coalesce(F.try_element_at(names, F.concat(F.lit("&#"), n.cast("string"), F.lit(";"))), char)).otherwise(char)

    def decode(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), lambda x: F.when(x.startswith("&#"), numeric(x)).otherwise(named(x)))
        parts = F.zip_with(F.split(t, _REFERENCE), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    return _once(text, decode)


def section_no_sort(no: Column) -> Column:
    """Byte-sortable key: digit runs padded to six, letter runs upper and padded to four, each ended by |. Null where that can't be."""
    runs = F.regexp_extract_all(no, F.lit("([0-9]+|[A-Za-z]+)"), F.lit(1))

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        number = F.when(F.length(digits) <= MAX_DIGITS, F.concat(F.lpad(digits, MAX_DIGITS, "0"), F.lit("|")))
        letters = F.when(F.length(x) <= MAX_LETTERS, F.concat(F.rpad(F.upper(x), MAX_LETTERS, " "), F.lit("|")))
        return F.when(x.rlike("^[0-9]"), number).otherwise(letters)

    parts = F.transform(runs, part)
    return F.when((F.size(runs) > 0) & ~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def normalise_no(no: Column) -> Column:
    return F.regexp_replace(F.lower(no), "[^0-9a-z]", "")


def normalise_title(title: Column) -> Column:
    spaced = F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"\bthe\b", " "), " +", " "))


def parse_date(raw: Column) -> Column:
    """ISO, dd-mm-yyyy or dd/mm/yyyy; null for anything else."""
    t = F.trim(raw)
    return F.coalesce(*(F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"))))


def html_to_text(fragment: Column) -> Column:
    """Block tags to line feeds, <sup>x</sup> to [x], references decoded twice, blanks squeezed, one empty line at most."""
    t = F.regexp_replace(F.regexp_replace(fragment, "(?s)<!--.*?-->", ""), r"(?i)<sup(\s[^>]*|/)?>", "[")
    t = F.regexp_replace(F.regexp_replace(t, "(?i)</sup>", "]"), r"(?i)</?(p|div|br|tr|li)(\s[^>]*|/)?>", "\n")
    t = decode_references(decode_references(F.regexp_replace(t, "</?[A-Za-z][^>]*>|<[!?][^>]*>", "")))
    t = F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.replace(t, F.lit("[]"), F.lit("")), r"^\s+|\s+\z", "")  # `$` would pass over a last U+0085 or U+2028


def footnotes(text: Column) -> Column:
    """array<struct<marker, text>>: cut before `[n].` or `n.` of one or two digits at a line's start; without a marker one note; blank bodies and text before the first marker go."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    markers, parts = F.regexp_extract_all(text, F.lit(FOOTNOTE_START), F.lit(1)), F.split(text, FOOTNOTE_START)
    notes = F.zip_with(markers, F.slice(parts, 2, F.size(parts)), lambda m, x: F.struct(m.alias("marker"), trimmed(x).alias("text")))
    one = F.array(F.struct(F.lit("").alias("marker"), trimmed(text).alias("text")))
    return F.filter(F.when(F.size(markers) > 0, notes).otherwise(one), lambda n: n["text"] != "")


def amendment_note(notes: Column) -> Column:
    """Texts of notes that speak of a change, by line; null if none does."""
    return F.nullif(F.array_join(F.filter(F.transform(notes, lambda n: n["text"]), lambda t: t.rlike(AMENDMENT_HINT)), "\n"), F.lit(""))


def looks_omitted(note: Column, body: Column) -> Column:
    """By the note, or by a body that begins with the old title in brackets and the word of its end."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(note), r"^[\[\].]+|[\[\].]+$", "")))
    text = F.regexp_replace(body, LEADING_MARKERS, "")
    return F.coalesce(bare.isin(*OMITTED_NOTES), F.lit(False)) | F.coalesce(text.rlike(OMITTED_BODY), F.lit(False))


def segments(text: Column) -> Column:
    """Pieces that begin at a line-start (n) or (nA), at a line-start Explanation, Illustration(s) or Exception, or at any word Provided."""
    pieces = F.transform(F.split(text, _SEGMENT_CUT), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def segment_label(piece: Column) -> Column:
    number = F.regexp_extract(piece, SEGMENT_NUMBER, 1)
    out = F.when(number != "", F.concat(F.lit("("), number, F.lit(")")))
    for word in ("Explanation", "Illustrations", "Illustration", "Exception", "Provided"):
        out = out.when(piece.startswith(word), F.lit(word))
    return out.otherwise("body")


def heading_prefix(title: Column, note: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(note, F.lit("")), r"\.+$", "")
    return F.concat(F.lit("passage: "), title, F.when(bare != "", F.concat(F.lit(" — "), bare)).otherwise(F.lit("")), F.lit(". "))


def indexed_text(heading: Column, text: Column) -> Column:
    """What the sparse index holds of a passage: its heading, without the embedding model's mark, and its text."""
    return F.concat_ws(" ", F.regexp_replace(heading, "^passage: ", ""), text)


def rerank_passage(heading: Column, text: Column) -> Column:
    return F.concat(F.regexp_replace(heading, "^passage: ", ""), text)


def snippet(text: Column, limit: int = 320) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", ""), F.lit("…")))


def word_count(text: Column) -> Column:
    """Words between white space: the default token counter."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def estimate_tokens(rendered: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(rendered) / 4)).cast("long")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def index_terms(text: Column) -> Column:
    """Terms without stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.isin(*STOP_WORDS))


def cited_ids(text: Column) -> Column:
    """Distinct ids of S<digits> words inside brackets that don't nest."""
    inside = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    found = F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"\bS([0-9]{1,12})\b"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("long"))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def redact(props: Column, drop: list[str], mask: list[str]) -> Column:
    """A JSON object's string map without the keys of `drop`; values of `mask` and of keys that end in _secret, _key or _token starred."""
    m = F.from_json(props, "map<string,string>")
    m = F.map_filter(m, lambda k, v: ~k.isin(drop))
    return F.transform_values(m, lambda k, v: F.when(k.isin(mask) | k.rlike("(_secret|_key|_token)$"), F.lit("***")).otherwise(v))


def client_key(forwarded: Column, peer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), peer, F.lit("unknown"))
