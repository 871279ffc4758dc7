"""Column functions over document text: labels, dates, names, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.scores import any_of

# Printed label variants per field.
LABELS = {
    "passport_no": ("PASSPORT NO", "PASSPORT NUMBER", "PASSPORTNO"),
    "full_names": ("FULL NAMES", "FULL NAME"),
    "surname": ("SURNAME",),
    "given_names": ("GIVEN NAMES", "GIVEN NAME", "GIVENNAMES"),
    "other_names": ("OTHER NAMES", "OTHER NAME"),
    "id_number": ("ID NUMBER", "ID NO", "IDENTITY NUMBER", "IDNUMBER"),
    "national_id_no": ("NATIONAL ID NO", "NATIONAL ID NUMBER", "NAT ID NO"),
    "licence": ("DRIVING LICENCE", "DRIVER'S LICENCE", "DRIVERS LICENCE", "DRIVER LICENCE"),
    "dob": ("DATE OF BIRTH", "BIRTH DATE", "D O B", "DOB"),
    "expiry": ("DATE OF EXPIRY", "DATE OF EXPIRATION", "EXPIRY DATE", "EXPIRY"),
    "national_identity_card": ("NATIONAL IDENTITY CARD", "NATIONAL IDENTITYCARD", "NATIONALIDENTITY CARD"),
}
# Title phrases of the newer national identity card.
NEW_CARD_PHRASES = ("NATIONAL IDENTITY CARD", "KITAMBULISHO CHA TAIFA")
# Words that mark a line as a label, not a name.
LABEL_WORDS = [
    "SURNAME", "GIVEN", "NAMES", "NAME", "FULL", "DATE", "BIRTH", "EXPIRY", "EXPIRATION", "PASSPORT",
    "NUMBER", "IDENTITY", "SEX", "MALE", "FEMALE", "NATIONAL", "REPUBLIC", "KENYA", "SIGNATURE",
    "HOLDER", "SERIAL", "OTHER", "DRIVING", "LICENCE", "LICENSE", "DRIVER",
]
MAX_AGE_DAYS = 120 * 365.25


def normal_label(text):
    """Upper case, other characters to spaces, zero to O, single spaces."""
    cleaned = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", " ")
    return F.trim(F.translate(cleaned, "0", "O"))


def plain_label(text):
    """The same normalisation for a fixed Python text."""
    kept = "".join(c if ("A" <= c <= "Z" or "0" <= c <= "9") else " " for c in text.upper())
    return " ".join(kept.replace("0", "O").split())


def has_label(normal, compact, variants):
    """Does a normalised text, or its form without spaces, contain a label variant."""
    names = list(dict.fromkeys(plain_label(v) for v in variants))
    short = list(dict.fromkeys(n.replace(" ", "") for n in names))
    return any_of([normal.contains(n) for n in names] + [compact.contains(n) for n in short])


def without_spaces(normal):
    return F.replace(normal, F.lit(" "), F.lit(""))


def has_phrase(normal, phrase):
    """Does a normalised text contain a phrase allowing about 15 % wrong letters.

    Either the phrase is damaged inside the text, or the text is a damaged fragment of the phrase.
    With k wrong letters allowed, one of k + 1 pieces of the phrase occurs unharmed, so windows are
    searched only around the places of such a piece; other texts cost a few substring tests.
    """
    needle = plain_label(phrase).replace(" ", "")
    n = len(needle)
    allowed = max(1, int(round(n * 0.15)))
    text = F.replace(normal, F.lit(" "), F.lit(""))
    size = F.length(text)
    close = lambda part, whole: F.levenshtein(part, whole, allowed) >= 0
    cuts = [round(i * n / (allowed + 1)) for i in range(allowed + 2)]
    pieces = [(a, needle[a:b]) for a, b in zip(cuts, cuts[1:])]
    # the text from up to the piece's place (and the allowed shift) before it to as far behind it
    around = F.concat(*[
        F.regexp_extract_all(text, F.lit(f"(?=(.{{0,{a + allowed}}}{piece}.{{0,{n - a - len(piece) + allowed}}}))"), F.lit(1)) for a, piece in pieces
    ])
    narrow, wide = max(2, n - allowed), n + allowed
    within = lambda part: F.exists(
        F.sequence(F.lit(narrow), F.least(F.lit(wide), F.length(part))),
        lambda w: F.exists(F.sequence(F.lit(1), F.length(part) - w + 1), lambda i: close(F.substr(part, i, w), F.lit(needle))),
    )
    inside = F.when(
        (size >= narrow) & any_of([text.contains(piece) for _, piece in pieces]), F.exists(around, lambda part: (F.length(part) >= narrow) & within(part))
    ).otherwise(False)
    fragments = _words(dict.fromkeys(needle[s:s + w] for w in range(2, n + 1) for s in range(n - w + 1)))
    near = lambda part: F.abs(F.length(part) - size) <= allowed
    # one of k + 1 pieces of such a text occurs in the phrase as it is
    edge = lambda i: F.floor(size * i / (allowed + 1)).cast("int")
    unharmed = any_of([F.lit(needle).contains(F.substr(text, edge(i) + 1, edge(i + 1) - edge(i))) for i in range(allowed + 1)])
    damaged = F.when((size >= 0.6 * n) & (size <= n + allowed) & unharmed, F.exists(fragments, lambda part: near(part) & close(part, text)))
    fragment = F.coalesce(damaged, F.lit(False))
    return F.when(size == 0, F.lit(False)).when(text.contains(needle), F.lit(True)).otherwise(inside | fragment)


def _words(words):
    """Constant array of texts, as one literal that is split when the plan is folded."""
    return F.split(F.lit("\n".join(words)), "\n")


def _first_match_patterns(variants):
    quote = lambda v: "".join("\\" + c if not c.isalnum() and c != " " else c for c in v)
    return [f"(?is)^(.*?){quote(v)}" for v in sorted(variants, key=len, reverse=True)]


def strip_label(text, label_key):
    """Text without the first occurrence of each variant of its label and without leading separators.

    ``label_key`` is a column, so one expression serves rows of different labels.
    """
    # patterns of a column are compiled at each use, so a text without the variant is not searched
    patterns = F.create_map(*[part for k, v in LABELS.items() for part in (F.lit(k), _words(_first_match_patterns(v)))])
    variants = F.create_map(*[part for k, v in LABELS.items() for part in (F.lit(k), _words(sorted(v, key=len, reverse=True)))])
    pairs = F.arrays_zip(F.try_element_at(patterns, label_key).alias("p"), F.try_element_at(variants, label_key).alias("v"))
    cut = lambda left, x: F.when(F.upper(left).contains(x["v"]), F.regexp_replace(left, x["p"], F.lit("$1 "))).otherwise(left)
    rest = F.aggregate(pairs, F.coalesce(text, F.lit("")), cut)
    return F.trim(F.regexp_replace(rest, r"^[\s:.\-]+", ""))


_TIGHT = r"(?<!\d)\d{1,2}[^\d\s]{1,3}\d{1,2}[^\d\s]{1,3}\d{4}(?!\d)"
_LOOSE = r"(?<!\d)\d{1,2}\s*[^\d\s]{1,3}\s*\d{1,2}\s*[^\d\s]{1,3}\s*\d{4}(?!\d)"
_PARTS = r"^(\d{1,2})\D+(\d{1,2})\D+(\d{4})$"


def document_date(text):
    """Date printed as day, month, year with tolerant separators; null when absent or not in the calendar."""
    tight = F.regexp_extract(F.regexp_replace(F.trim(text), r"\s+", ""), _TIGHT, 0)
    hit = F.coalesce(F.nullif(tight, F.lit("")), F.regexp_extract(F.trim(text), _LOOSE, 0))
    return F.try_to_date(F.regexp_replace(hit, _PARTS, "$3-$2-$1"), "yyyy-M-d")


def registered_date(text):
    """Stored date: as printed, else ISO, else dd/mm/yyyy."""
    text = text.cast("string")
    compact = F.regexp_replace(F.trim(text), r"\s+", "")
    iso = F.try_to_date(F.substring(compact, 1, 10), "yyyy-MM-dd")
    return F.coalesce(document_date(text), F.when(compact.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).otherwise(F.try_to_date(compact, "d/M/yyyy")))


def birth_date_problem(born, today):
    return (
        F.when(born.isNull(), F.lit("Date of birth could not be parsed")).when(born > today, F.lit("Date of birth is in the future"))
        .when(F.date_diff(today, born) > MAX_AGE_DAYS, F.lit("Date of birth implies age over 120"))
    )


def expiry_problem(expires, today):
    return F.when(expires.isNull(), F.lit("Date of expiry could not be parsed")).when(expires < today, F.lit("Document has expired"))


def name_tokens(text):
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def normal_name(text):
    return F.array_join(name_tokens(text), " ")


def normal_id(text):
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))


def similarity(left, right):
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(left, right) / longest)


def looks_like_name(text):
    tokens = name_tokens(text)
    words = _words(LABEL_WORDS)
    return (F.size(tokens) > 0) & ~F.arrays_overlap(tokens, words) & ~text.rlike(r"\d")


def looks_like_id(text):
    compact = normal_id(text)
    return (F.length(compact) >= 5) & compact.rlike("[0-9]")


def looks_like_date(text):
    return document_date(text).isNotNull()


def ids_agree(printed, number):
    """Numbers agree when one contains the other, tolerating stray characters around the digits."""
    pair = F.struct(normal_id(printed).alias("a"), normal_id(number).alias("b"), F.regexp_replace(F.coalesce(printed, F.lit("")), "[^0-9]", "").alias("d"))

    def agree(p):
        same = p["a"].contains(p["b"]) | ((F.length(p["a"]) >= 7) & p["b"].contains(p["a"])) | p["d"].contains(p["b"])
        return (p["a"] != "") & (p["b"] != "") & same

    return F.exists(F.array(pair), agree)


MATCH_COLUMNS = [
    "name_match", "id_match", "dob_match", "matched", "confidence", "coverage", "token_overlap", "levenshtein", "registered_dob_parse_failed",
]


def with_identity_match(rows, extracted_name, extracted_id, extracted_dob, name, id_number, date_of_birth):
    """Add name, number and birth-date agreement with the registration (all arguments are column names).

    Names agree when at least two whole tokens are shared and the shorter name is fully covered.
    """
    step = rows.select(
        "*", F.array_distinct(name_tokens(F.col(extracted_name))).alias("_l"), F.array_distinct(name_tokens(F.col(name))).alias("_r"),
        normal_name(F.col(extracted_name)).alias("_ln"), normal_name(F.col(name)).alias("_rn"), normal_id(F.col(extracted_id)).alias("_li"),
        normal_id(F.col(id_number)).alias("_ri"), registered_date(F.col(date_of_birth)).alias("_rd"),
    )
    step = step.select("*", F.size(F.array_intersect("_l", "_r")).alias("_shared"), F.size("_l").alias("_nl"), F.size("_r").alias("_nr"))
    both = (F.col("_nl") > 0) & (F.col("_nr") > 0)
    ratio = lambda size: F.when(both, F.col("_shared") / size).otherwise(F.lit(0.0))
    step = step.select(
        "*", ratio(F.least("_nl", "_nr")).alias("_coverage"), ratio(F.greatest("_nl", "_nr")).alias("_overlap"),
        ((F.col("_li") != "") & (F.col("_li") == F.col("_ri"))).alias("_id"), F.coalesce(F.col(extracted_dob) == F.col("_rd"), F.lit(False)).alias("_dob"),
    )
    name_match = (F.col("_shared") >= 2) & (F.col("_coverage") == 1)
    confidence = (F.col("_coverage") + F.col("_id").cast("double") + F.col("_dob").cast("double")) / 3
    given = F.coalesce(F.trim(F.col(date_of_birth).cast("string")) != "", F.lit(False))
    return step.select(
        *rows.columns, name_match.alias("name_match"), F.col("_id").alias("id_match"), F.col("_dob").alias("dob_match"),
        (name_match & F.col("_id") & F.col("_dob")).alias("matched"), F.round(confidence, 4).alias("confidence"), F.round("_coverage", 4).alias("coverage"),
        F.round("_overlap", 4).alias("token_overlap"), F.round(similarity(F.col("_ln"), F.col("_rn")), 4).alias("levenshtein"),
        (F.col("_rd").isNull() & given).alias("registered_dob_parse_failed"),
    )
