"""Document text to identity: type detection, fields near labels, records, votes and verdicts.

The input is a table of text items of document pages (one row per printed line or box). All steps are
joined and grouped by document, so one partitioning by document id carries through.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.functions import text as x
from veriframe.functions.scores import any_of, compact_array
from veriframe.session import cut_lineage

CONFIDENCE_FILTER = 0.4
PASSPORT, CARD_OLD, CARD_NEW, CARD_BACK, LICENCE = (
    "passport", "id_v1_full_name", "id_v2_surname_given", "id_back", "drivers_licence"
)
CARD_FRONTS = (CARD_OLD, CARD_NEW)
EXPIRING = (PASSPORT, CARD_NEW, LICENCE)
# Field, label and kind of value per document type, in reading order.
FIELD_SPECS = {
    PASSPORT: [("surname", "surname", "name"), ("given_names", "given_names", "name"), ("passport_no", "passport_no", "id"),
               ("date_of_birth", "dob", "date"), ("date_of_expiry", "expiry", "date")],
    CARD_OLD: [("full_names", "full_names", "name"), ("id_number", "id_number", "id"), ("date_of_birth", "dob", "date")],
    CARD_NEW: [("surname", "surname", "name"), ("given_names", "given_names", "name"), ("id_number", "id_number", "id"),
               ("date_of_birth", "dob", "date"), ("date_of_expiry", "expiry", "date")],
    CARD_BACK: [("id_number", "id_number", "id")],
    LICENCE: [("surname", "surname", "name"), ("other_names", "other_names", "name"), ("id_number", "national_id_no", "id"),
              ("date_of_birth", "dob", "date"), ("date_of_expiry", "expiry", "date")],
}
RAW_FIELDS = ["surname", "given_names", "other_names", "full_names", "id_number", "passport_no", "date_of_birth", "date_of_expiry"]
FIELD_LABELS = ["full_names", "surname", "given_names", "other_names", "id_number", "dob", "expiry"]
PAGE = ["doc_id", "side"]


def usable_items(items, minimum=CONFIDENCE_FILTER, trimmed=True):
    """Items with text and enough confidence; without ``trimmed`` texts keep the spaces around them."""
    rows = items.withColumn("text", F.trim("text")) if trimmed else items
    return rows.where((F.trim("text") != "") & (F.col("confidence") >= minimum))


def document_types(items):
    """Type per page from label anchors; null when unknown.

    Labels are tested per item and once on the page text, which also catches labels split over items.
    """
    rows = items.select(*PAGE, "item_no", "text", x.normal_label(F.col("text")).alias("_n")).withColumn("_c", x.without_spaces(F.col("_n")))
    seen = lambda key: F.bool_or(x.has_label(F.col("_n"), F.col("_c"), x.LABELS[key]))
    keys = ["passport_no", "full_names", "surname", "given_names", "other_names", "id_number", "national_id_no", "licence", "national_identity_card"]
    phrase = F.bool_or(any_of([x.has_phrase(F.col("_n"), p) for p in x.NEW_CARD_PHRASES]))
    pages = rows.groupBy(*PAGE).agg(
        *[seen(k).alias(k) for k in keys], phrase.alias("_phrase"), F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "text"))), lambda i: i["text"]), " ").alias("_page"),
    )
    pages = pages.withColumn("_n", x.normal_label(F.col("_page"))).withColumn("_c", x.without_spaces(F.col("_n")))
    on_page = lambda key: x.has_label(F.col("_n"), F.col("_c"), x.LABELS[key])
    licence = F.col("licence") | on_page("licence") | F.col("other_names") | (F.col("national_id_no") & F.col("surname"))
    new_card = (
        (F.col("surname") & F.col("given_names") & F.col("id_number")) | F.col("national_identity_card") | F.col("_phrase")
        | on_page("national_identity_card") | any_of([x.has_phrase(F.col("_n"), p) for p in x.NEW_CARD_PHRASES])
    )
    kind = (
        F.when(F.col("passport_no") | on_page("passport_no"), F.lit(PASSPORT)).when(F.col("full_names"), F.lit(CARD_OLD))
        .when(licence, F.lit(LICENCE)).when(new_card, F.lit(CARD_NEW))
    )
    labels = any_of([F.col(k) for k in FIELD_LABELS if k in keys])
    return pages.select(*PAGE, kind.alias("document_type"), "n_items", labels.alias("_labels"))


def label_items(items, keys=tuple(x.LABELS)):
    """Label box per page and label key: the first item with the label, else the first adjacent pair.

    Columns: page, label_key, item_no (null for a pair), text and box.
    """
    order = Window.partitionBy(*PAGE).orderBy("item_no")  # items of one page
    box = ["text", "x_min", "x_max", "y_min", "y_max"]
    rows = items.select(*PAGE, "item_no", *box, F.lead(F.struct(*box)).over(order).alias("_next"))
    place = lambda number, single, text, columns: F.struct(
        F.lit(number).alias("_pass"), F.col("item_no").cast("bigint").alias("item_no"), single.cast("bigint").alias("label_no"), text.alias("text"),
        *[c.alias(n) for c, n in zip(columns, box[1:])])
    merged = [f(F.col(c), F.col(f"_next.{c}")) for c, f in zip(box[1:], (F.least, F.greatest, F.least, F.greatest))]
    both = compact_array(
        place(0, F.col("item_no"), F.col("text"), [F.col(c) for c in box[1:]]),
        F.when(F.col("_next").isNotNull(), place(1, F.lit(None), F.concat_ws(" ", "text", "_next.text"), merged)),
    )
    boxes = rows.select(*PAGE, F.inline(both))
    # as generated columns, these are worked out once; others would be once per test in the filter that Spark derives from ``found``
    boxes = boxes.select("*", F.explode(F.array(x.normal_label(F.col("text")))).alias("_n"))
    boxes = boxes.select("*", F.explode(F.array(x.without_spaces(F.col("_n")))).alias("_c"))
    found = compact_array(*[F.when(x.has_label(F.col("_n"), F.col("_c"), x.LABELS[k]), F.lit(k)) for k in keys])
    columns = ["_pass", "item_no", "label_no", *box]
    tagged = boxes.select(*PAGE, *columns, F.explode(found).alias("label_key"))
    first = tagged.groupBy(*PAGE, "label_key").agg(F.min(F.struct(*columns)).alias("_r"))
    return first.select(*PAGE, "label_key", *[F.col(f"_r.{c}").alias(c) for c in columns[2:]])


def spatial_candidates(labels, items):
    """Items right of a label in its row, or below it in its column (theta join inside the page).

    Columns: page, label_key, side_group (0 right, 1 below), position, text.
    """
    l = labels.select(*PAGE, "label_key", "label_no", *[F.col(c).alias(f"l_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    rows = l.join(items, PAGE).where(~F.col("item_no").eqNullSafe(F.col("label_no")))
    height, own = F.col("l_y_max") - F.col("l_y_min"), F.col("y_max") - F.col("y_min")
    shared = F.least("l_y_max", "y_max") - F.greatest("l_y_min", "y_min")
    least_height = F.least(height, own)
    same_row = shared / F.when(least_height == 0, 1.0).otherwise(least_height) >= 0.45
    right = (F.col("x_min") >= F.col("l_x_max") - 4) & same_row
    column = F.least(F.col("l_x_max") + (F.col("l_x_max") - F.col("l_x_min")) * 3, F.col("x_max")) - F.greatest("l_x_min", "x_min")
    below = (F.col("y_min") >= F.col("l_y_max") - height * 0.35) & (column > 0)
    group = F.when(right, F.lit(0)).when(below, F.lit(1))
    return rows.withColumn("side_group", group).where(F.col("side_group").isNotNull()).select(
        *PAGE, "label_key", "side_group", F.when(F.col("side_group") == 0, F.col("x_min")).otherwise(F.col("y_min")).alias("position"), "item_no", "text"
    )


def passes(kind, value):
    return F.when(kind == "name", x.looks_like_name(value)).when(kind == "id", x.looks_like_id(value)).otherwise(x.looks_like_date(value))


_TRIES = "array<struct<g:int,i:int,k:int>>"


def _tries(groups):
    """What is tried, in order: each text of a group by itself, 2 to 5 neighbours from each start, all together; group after group."""
    of = lambda g: f"element_at({groups}, {g})"
    part = lambda g: f"""concat(
        transform(sequence(1, size({of(g)})), i -> struct({g} as g, i, 1 as k)),
        flatten(transform(sequence(1, size({of(g)})), i -> transform(sequence(2, 5), k -> struct({g} as g, i, k)))),
        array(struct({g} as g, 1 as i, size({of(g)}) as k)))"""
    known = lambda g: f"case when size({of(g)}) > 0 then filter({part(g)}, x -> x.i + x.k - 1 <= size({of(g)})) else cast(array() as {_TRIES}) end"
    return F.expr(f"concat({known(1)}, {known(2)}, {known(3)})")


def _first_fitting(groups, kind):
    """The first text that passes; texts behind it are not joined or tested."""

    def tried(found, place):
        text = F.array_join(F.slice(F.element_at(groups, place["g"]), place["i"], place["k"]), " ")
        return F.coalesce(found, F.element_at(F.transform(F.array(text), lambda t: F.when((t != "") & passes(kind, t), t)), 1))

    return F.aggregate(F.col("_tries"), F.lit(None).cast("string"), tried)


def values_near_labels(items, wanted):
    """Value per (page, field): rest of the label text, else the first fitting text right of or below it.

    ``wanted``: page, field, label_key, kind. The texts beside a label are put in order once; one walk over them finds the
    first that fits, so nothing behind it is built, and a page costs as much as it has texts.
    """
    labels = label_items(items, tuple(dict.fromkeys(label for spec in FIELD_SPECS.values() for _, label, _ in spec)))
    labels = labels.join(wanted.select(*PAGE, "label_key").distinct(), [*PAGE, "label_key"], "left_semi")
    rest = labels.select(*PAGE, "label_key", x.strip_label(F.col("text"), F.col("label_key")).alias("_rest"))
    beside = lambda g: F.sort_array(F.collect_list(F.when(F.col("side_group") == g, F.struct("position", "item_no", "text"))))
    near = spatial_candidates(labels, items).groupBy(*PAGE, "label_key").agg(beside(0).alias("_right"), beside(1).alias("_below"))
    asked = wanted.join(rest, [*PAGE, "label_key"]).join(near, [*PAGE, "label_key"], "left")
    groups = "array(array(coalesce(_rest, '')), coalesce(transform(_right, t -> t.text), cast(array() as array<string>)), coalesce(transform(_below, t -> t.text), cast(array() as array<string>)))"
    tried = asked.withColumn("_groups", F.expr(groups)).withColumn("_tries", _tries("_groups"))
    values = tried.select(*PAGE, "field", _first_fitting(F.col("_groups"), F.col("kind")).alias("value"))
    return values.where(F.col("value").isNotNull())


def _spec_array(kind):
    return F.array(*[F.struct(F.lit(f).alias("field"), F.lit(l).alias("label_key"), F.lit(k).alias("kind")) for f, l, k in FIELD_SPECS[kind]])


def wanted_fields(types):
    """(page, field, label_key, kind) rows for typed pages."""
    spec = F.coalesce(*[F.when(F.col("document_type") == t, _spec_array(t)) for t in FIELD_SPECS])
    return types.where(F.col("document_type").isNotNull()).select(*PAGE, F.inline(spec))


def raw_fields(items, types, found=None):
    """One row per page with the raw text of every field; ``found`` are values near labels, if they are known."""
    found = values_near_labels(items, wanted_fields(types)) if found is None else found
    wide = found.groupBy(*PAGE).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in RAW_FIELDS])
    return types.join(wide, PAGE, "left")


def unlabelled_birth_dates(items, expiries, today):
    """Text of the only plausible birth date on a page, if there is exactly one.

    ``expiries``: page and date_of_expiry text (may be null); that date is not a birth date.
    """
    listed = F.sort_array(F.collect_list(F.struct("item_no", "text")))
    pages = items.groupBy(*PAGE).agg(listed.alias("_l")).select(*PAGE, F.expr("transform(_l, i -> i.text) texts"), F.size("_l").alias("n"))
    pages = pages.join(expiries.select(*PAGE, x.document_date(F.col("date_of_expiry")).alias("_expires")), PAGE)
    # each text by itself, 2 to 5 neighbours, all together
    tries = F.expr("""filter(concat(
        transform(texts, (t, i) -> struct(0 as phase, i + 1 as start, 1 as size, t as candidate)),
        flatten(transform(sequence(2, 5), k -> transform(texts, (t, i) -> struct(1 as phase, i + 1 as start, k as size,
            case when i + k <= n then array_join(slice(texts, i + 1, k), ' ') end as candidate)))),
        array(struct(2 as phase, 1 as start, 0 as size, case when n > 1 then array_join(texts, ' ') end as candidate))
    ), c -> c.candidate rlike '[0-9]([^0-9]*[0-9]){5}')""")  # a date has six digits at least
    rows = pages.select(*PAGE, "_expires", F.inline(tries))
    # generated columns are worked out once, however often they are asked for
    rows = rows.select("*", F.explode(F.array(x.document_date(F.col("candidate")))).alias("born")).where(
        F.col("born").isNotNull() & ~F.col("born").eqNullSafe(F.col("_expires")) & x.birth_date_problem(F.col("born"), today).isNull()
    )
    first = rows.groupBy(*PAGE).agg(
        F.min("born").alias("_low"), F.max("born").alias("_high"), F.min(F.struct("phase", "start", "size", "candidate"))["candidate"].alias("value")
    )
    return first.where(F.col("_low") == F.col("_high")).select(*PAGE, "value", F.col("_low").alias("born"))


def lines_below(items, anchors):
    """Line printed directly under an anchor text in its column, if it looks like a name.

    ``anchors``: page and anchor_text. The first item with that text is the anchor.
    """
    tagged = items.withColumn("_n", x.normal_label(F.col("text")))
    named = anchors.withColumn("_n", x.normal_label(F.col("anchor_text")))
    box = ["item_no", "x_min", "x_max", "y_min", "y_max"]
    first = tagged.join(named, [*PAGE, "_n"]).groupBy(*PAGE).agg(F.min(F.struct(*box)).alias("_a"))
    rows = first.join(items, PAGE)
    height = F.col("_a.y_max") - F.col("_a.y_min")
    gap = F.col("y_min") - F.col("_a.y_max")
    near = (gap >= -height * 0.3) & (gap <= height * 2.5) & (F.col("x_min") <= F.col("_a.x_max")) & (F.col("x_max") >= F.col("_a.x_min") - height * 2)
    fitting = rows.where(near & x.looks_like_name(F.col("text")))
    return fitting.groupBy(*PAGE).agg(F.min(F.struct(gap.alias("gap"), "item_no", "text"))["text"].alias("value"))


def with_fallbacks(raw, items, today):
    """Fill given names from the line under the surname and the birth date from the only plausible one.

    Both apply only to pages on which no field label was read.
    """
    bare = raw.where(~F.coalesce("_labels", F.lit(False)))
    anchors = bare.where((F.col("document_type") == CARD_NEW) & F.col("surname").isNotNull() & F.col("given_names").isNull()).select(
        *PAGE, F.col("surname").alias("anchor_text"))
    below = lines_below(items, anchors).withColumnRenamed("value", "_below")
    expected = F.col("document_type").isin(PASSPORT, CARD_OLD, CARD_NEW, LICENCE)
    dates = unlabelled_birth_dates(items, bare.where(expected & F.col("date_of_birth").isNull()).select(*PAGE, "date_of_expiry"), today)
    rows = raw.join(below, PAGE, "left").join(dates.select(*PAGE, F.col("value").alias("_date")), PAGE, "left")
    return rows.withColumn("given_names", F.coalesce("given_names", "_below")).withColumn("date_of_birth", F.coalesce("date_of_birth", "_date")).drop("_below", "_date")


def missing_fields(raw):
    """Array of required fields without text, in reading order."""
    blank = lambda f: F.coalesce(F.trim(F.col(f)) == "", F.lit(True))
    return F.coalesce(*[
        F.when(F.col("document_type") == t, compact_array(*[F.when(blank(f), F.lit(f)) for f, _, _ in spec])) for t, spec in FIELD_SPECS.items()
    ], F.array().cast("array<string>"))


def canonical(raw, today):
    """Name, number, dates and their problems in one shape for all document types."""
    t = F.col("document_type")
    join = lambda a, b: F.concat_ws(" ", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    name = (
        F.when(t.isin(PASSPORT, CARD_NEW), join("surname", "given_names")).when(t == CARD_OLD, F.coalesce("full_names", F.lit("")))
        .when(t == LICENCE, join("surname", "other_names")).otherwise(F.lit(""))
    )
    rows = raw.select(
        "*", F.nullif(x.normal_name(name), F.lit("")).alias("full_name"),
        F.nullif(x.normal_id(F.when(t == PASSPORT, F.col("passport_no")).otherwise(F.col("id_number"))), F.lit("")).alias("number"),
        x.document_date(F.col("date_of_birth")).alias("_born"), x.document_date(F.col("date_of_expiry")).alias("expires"),
    )
    rows = rows.withColumn("dob_problem", x.birth_date_problem(F.col("_born"), today))
    return rows.select(
        *[c for c in rows.columns if c != "_born"], F.when(F.col("dob_problem").isNull(), F.col("_born")).alias("born"),
        F.when(t.isin(*EXPIRING), x.expiry_problem(F.col("expires"), today)).alias("expiry_problem"),
    )


def front_back(fronts, backs):
    """Number on the back against the number on the front, per document."""
    f = fronts.select("doc_id", x.normal_id(F.col("id_number")).alias("front_id"))
    b = backs.select("doc_id", x.normal_id(F.col("id_number")).alias("back_id"))
    same = (F.col("front_id") != "") & (F.col("back_id") != "") & ((F.col("front_id") == F.col("back_id")) | x.ids_agree(F.col("back_id"), F.col("front_id")))
    return f.join(b, "doc_id").withColumn("id_match", same)


def vote_numbers(readings, context):
    """Number most sources agree on per document.

    ``readings``: doc_id, reading_no, value. ``context``: doc_id, id_number (current), back_number,
    zone_number, zone_verified. One vote per reading, +3 (or +2 unverified) when the zone agrees, else
    +1.5 when the back agrees; ties go to the current number, then to the first seen.
    """
    clean = readings.select("doc_id", "reading_no", x.normal_id(F.col("value")).alias("value")).where(
        F.length(F.regexp_replace("value", "[^0-9]", "")) >= 5
    )
    votes = clean.groupBy("doc_id", "value").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("reading_no").alias("first_seen"))
    rows = votes.join(context, "doc_id")
    zone, back = x.normal_id(F.col("zone_number")), x.normal_id(F.col("back_number"))
    weight = F.when(F.coalesce("zone_verified", F.lit(True)), 3.0).otherwise(2.0)
    bonus = F.when((zone != "") & (F.col("value") == zone), weight).when((back != "") & x.ids_agree(back, F.col("value")), 1.5).otherwise(0.0)
    current = (F.col("value") == x.normal_id(F.col("id_number"))).cast("int")
    best = rows.select("doc_id", "value", (F.col("n") + bonus).alias("votes"), current.alias("is_current"), (-F.col("first_seen")).alias("order"))
    return best.groupBy("doc_id").agg(F.max(F.struct("votes", "is_current", "order", "value")).alias("_b")).select(
        "doc_id", F.col("_b.value").alias("id_number"), F.col("_b.votes").alias("votes"))


ZONE = ["document_number", "id_number_verified", "surname", "given_names", "full_names", "date_of_birth", "date_of_expiry"]


def fill_from_zone(raw, zones):
    """Identity fields from a valid zone; printed values are kept beside them as ``printed_*``.

    A number that is not covered by a check digit only fills a gap.
    """
    z = zones.select("doc_id", *[F.col(c).alias(f"z_{c}") for c in ZONE], F.lit(True).alias("_zone"))
    rows = raw.join(z, "doc_id", "left")
    t, on = F.col("document_type"), F.coalesce("_zone", F.lit(False))
    full = F.coalesce("z_full_names", F.concat_ws(" ", "z_surname", "z_given_names"))
    full = F.when(full != "", full)
    split = F.col("z_surname").isNotNull() | F.col("z_given_names").isNotNull()
    two_part = t.isin(CARD_NEW, PASSPORT)
    shown = lambda c: F.date_format(c, "dd.MM.yyyy")
    verified = F.coalesce("z_id_number_verified", F.lit(True))
    number = F.when(verified, F.col("z_document_number"))
    gap = lambda field: F.when(F.coalesce(F.col(field) == "", F.lit(True)), F.col("z_document_number"))
    new = {
        "surname": F.when(two_part, F.when(split, F.col("z_surname")).otherwise(full)).when(t == LICENCE, F.coalesce("z_surname", full)),
        "given_names": F.when(two_part & split, F.col("z_given_names")),
        "other_names": F.when(t == LICENCE, F.col("z_given_names")), "full_names": F.when(t == CARD_OLD, full),
        "date_of_birth": shown("z_date_of_birth"), "date_of_expiry": shown("z_date_of_expiry"),
        "passport_no": F.when(t == PASSPORT, F.coalesce(number, gap("passport_no"))), "id_number": F.when(t != PASSPORT, F.coalesce(number, gap("id_number"))),
    }
    cleared = two_part & ~split & full.isNotNull()
    value = lambda c: F.when(on & new[c].isNotNull(), new[c]).otherwise(F.when(on & cleared, F.lit(None)).otherwise(F.col(c)) if c == "given_names" else F.col(c))
    changed = lambda c: F.when(~value(c).eqNullSafe(F.col(c)), F.col(c))
    return rows.select(
        *[c for c in raw.columns if c not in new], *[value(c).alias(c) for c in new], *[changed(c).alias(f"printed_{c}") for c in ("surname", "given_names", "id_number")],
        on.alias("zone_used"), "z_document_number",
    )


# Fixed texts of the verdict.
NOT_FOUND = (
    "We could not find a readable document in the photo. Place it on a plain, dark surface, fill the frame with it, and avoid glare."
)
TOO_SMALL = "The document is too small in the photo. Move the camera closer so the card fills most of the frame."
NO_TEMPLATE = "Could not match a known document template. Flagged for manual review."
MIN_ITEMS = 6


READ_ID = "_read_id"  # the id number beside its plain label, sought on licences beside their own field


def verdict_fields(types):
    """(page, field, label_key, kind) of all that a verdict reads beside labels, so that one walk over the pages finds it.

    The fields of the fronts, the plain id number of licences, and the number on the backs of two-sided cards.
    """
    licences = types.where(F.col("document_type") == LICENCE).select(
        *PAGE, F.lit(READ_ID).alias("field"), F.lit("id_number").alias("label_key"), F.lit("id").alias("kind"))
    backs = types.where(F.col("document_type").isin(*CARD_FRONTS)).select("doc_id", F.lit("back").alias("side"), F.lit(CARD_BACK).alias("document_type"))
    return wanted_fields(types).unionByName(licences).unionByName(wanted_fields(backs))


def page_readings(items, raw, read_ids):
    """Readings of the id number on the front: the chosen one, the labelled one (``read_ids`` on licences), and bare numbers.

    ``raw`` holds the numbers found beside labels; on cards that is the labelled one too.
    """
    chosen = raw.where(F.col("id_number").isNotNull()).select("doc_id", F.lit(-2).alias("reading_no"), F.col("id_number").alias("value"))
    fronts = items.where(F.col("side") == "front")
    on_cards = raw.where(F.col("document_type").isin(*CARD_FRONTS) & F.col("id_number").isNotNull()).select("doc_id", F.col("id_number").alias("value"))
    labelled = on_cards.unionByName(read_ids.select("doc_id", "value")).select("doc_id", F.lit(-1).alias("reading_no"), "value")
    token = x.normal_id(F.col("text"))
    typed = raw.where(F.col("document_type").isin(CARD_OLD, CARD_NEW, LICENCE)).select("doc_id")
    bare = fronts.where(token.rlike(r"^\d{7,10}$")).select("doc_id", F.col("item_no").cast("int").alias("reading_no"), token.alias("value"))
    return chosen.unionByName(labelled).unionByName(bare.join(typed, "doc_id", "left_semi"))


def document_verdicts(items, zones, registered, today, pages=None):
    """Verdict per document: retake, review or matched, with the reason.

    ``zones``: parsed zones by doc_id and side. ``registered``: doc_id, name, id_number,
    date_of_birth. ``pages`` may give ``located`` and
    ``too_small`` per doc_id from the photo step; documents count as located without it.
    """
    everyone = items.select("doc_id").union(registered.select("doc_id")).union(zones.select("doc_id")).distinct()
    items = cut_lineage(usable_items(items), "items")
    fronts, backs = items.where(F.col("side") == "front"), items.where(F.col("side") == "back")
    # a document without a usable front item keeps its row: it has no type and no items
    found = everyone.withColumn("side", F.lit("front")).join(document_types(fronts), PAGE, "left")
    found = found.withColumn("n_items", F.coalesce("n_items", F.lit(0))).withColumn("_labels", F.coalesce("_labels", F.lit(False)))
    types = cut_lineage(found, "types")
    zones = cut_lineage(zones.select("doc_id", "side", "valid", *ZONE), "zones")
    has_back = backs.groupBy("doc_id").agg(F.lit(True).alias("_has_back"))
    zone_back = zones.where(F.col("side") == "back").select("doc_id", F.lit(True).alias("_back_zone"))
    types = types.join(has_back, "doc_id", "left").join(zone_back, "doc_id", "left")
    # an unreadable front whose back carries a zone is the newer card
    kind = F.coalesce("document_type", F.when(F.col("_back_zone"), F.lit(CARD_NEW)))
    types = types.withColumn("document_type", kind)
    # the raw record feeds several later steps, so it is written once
    types = cut_lineage(types, "typed-pages")
    found = cut_lineage(values_near_labels(items, verdict_fields(types)), "found-values")
    raw = cut_lineage(raw_fields(fronts, types, found.where((F.col("side") == "front") & (F.col("field") != READ_ID))), "raw-fields")
    raw = cut_lineage(with_fallbacks(raw, fronts, today), "filled-fields")
    back_numbers = found.where(F.col("side") == "back").select("doc_id", F.col("value").alias("back_number"))

    sided = zones.where("valid").withColumn("_p", F.when(F.col("side") == "back", 0).otherwise(1))
    picked = sided.groupBy("doc_id").agg(F.min(F.struct("_p", *ZONE)).alias("_z")).select("doc_id", *[F.col(f"_z.{c}").alias(c) for c in ZONE])
    # the back is read only for two-sided cards
    two_sided = F.col("document_type").isin(*CARD_FRONTS)

    context = raw.select("doc_id", "id_number").join(back_numbers, "doc_id", "left").join(
        picked.select("doc_id", F.col("document_number").alias("zone_number"), F.col("id_number_verified").alias("zone_verified")), "doc_id", "left")
    readings = cut_lineage(page_readings(items, raw, found.where(F.col("field") == READ_ID)), "readings")
    voted = vote_numbers(readings, context).select("doc_id", F.col("id_number").alias("_voted"))
    raw = raw.join(voted, "doc_id", "left").join(back_numbers, "doc_id", "left")
    raw = raw.withColumn("_chosen", F.col("id_number")).withColumn("id_number", F.coalesce("_voted", "id_number"))
    agreed = readings.join(picked.select("doc_id", F.col("document_number").alias("_zn")), "doc_id").groupBy("doc_id").agg(
        F.bool_or(x.ids_agree(F.col("value"), F.col("_zn"))).alias("_readings_agree"))
    filled = fill_from_zone(raw, picked).join(agreed, "doc_id", "left")

    printed_match = x.ids_agree(F.col("back_number"), F.coalesce("_voted", "_chosen"))
    # the number after filling is compared too, so a verified zone always agrees with its own card
    zone_match = (
        F.coalesce("_readings_agree", F.lit(False)) | x.ids_agree(F.col("id_number"), F.col("z_document_number"))
        | x.ids_agree(F.coalesce("printed_id_number", "id_number"), F.col("z_document_number"))
    )
    with_back = two_sided & F.coalesce("_has_back", F.lit(False))
    sides = F.when(~with_back, F.lit(None)).when(F.col("zone_used") & F.col("z_document_number").isNotNull(), zone_match).otherwise(printed_match)
    rows = canonical(filled.withColumn("front_back_match", sides), today).join(registered.select(
        "doc_id", F.col("name").alias("r_name"), F.col("id_number").alias("r_id"), F.col("date_of_birth").alias("r_dob")), "doc_id", "left")
    rows = x.with_identity_match(rows, "full_name", "number", "born", "r_name", "r_id", "r_dob")
    if pages is not None:
        rows = rows.join(pages.select("doc_id", "located", "too_small"), "doc_id", "left")
    else:
        rows = rows.withColumn("located", F.lit(True)).withColumn("too_small", F.lit(False))

    no_back = two_sided & ~F.coalesce("_has_back", F.lit(False))
    back_blank = with_back & F.coalesce(F.trim("back_number") == "", F.lit(True))
    needs_expiry = F.col("document_type").isin(*EXPIRING)
    rows = rows.withColumn("_listed", missing_fields(rows))
    absent = lambda f: ~F.array_contains("_listed", f)
    missing = F.concat(
        "_listed", compact_array(F.when(no_back, F.lit("id_back")), F.when(back_blank, F.lit("back_id_number"))),
        compact_array(
            F.when(F.col("born").isNull() & absent("date_of_birth"), F.lit("date_of_birth")),
            F.when(needs_expiry & F.col("expires").isNull() & absent("date_of_expiry"), F.lit("date_of_expiry")),
        ),
    )
    rows = rows.select(
        "*", missing.alias("_missing"), F.col("document_type").isNull().alias("_unknown"), F.coalesce("front_back_match", F.lit(True)).alias("_sides_ok"),
        F.coalesce(needs_expiry & F.col("expires").isNotNull() & F.col("expiry_problem").isNotNull(), F.lit(False)).alias("_expired"),
        (F.col("registered_dob_parse_failed") | (F.col("born").isNull() & F.col("date_of_birth").isNotNull())).alias("_parse_failed"),
    )
    lost = ~F.col("_unknown") & ~F.coalesce("located", F.lit(True)) & (F.size(F.array_remove("_missing", "id_back")) > 0)
    rows = rows.select("*", lost.alias("_lost"), (F.size("_missing") > 0).alias("_incomplete"))
    rows = rows.select("*", ((F.col("_unknown") & (F.col("n_items") < MIN_ITEMS)) | F.col("_lost")).alias("needs_retake"), (F.col("_unknown") | F.col("_lost")).alias("_stopped"))
    reason = (
        F.when(F.col("_unknown"), F.when(F.col("needs_retake"), F.lit(NOT_FOUND)).otherwise(F.lit(NO_TEMPLATE)))
        .when(F.col("_lost"), F.when(F.coalesce("too_small", F.lit(False)), F.lit(TOO_SMALL)).otherwise(F.lit(NOT_FOUND)))
        .when(F.col("_expired"), F.col("expiry_problem")).when(~F.col("_sides_ok"), F.lit("ID number on the back does not match the front"))
        .when(F.col("_incomplete"), F.concat(F.lit("Required fields could not be extracted after template crop and label fallback: "), F.array_join("_missing", ", ")))
        .otherwise(F.col("dob_problem"))
    )
    bad = F.col("_expired") | ~F.col("_sides_ok")
    review = F.col("dob_problem").isNotNull() | F.col("_parse_failed") | F.col("_incomplete") | bad
    no = F.lit(False)
    open_ = lambda value, closed, name: F.when(F.col("_stopped"), closed).otherwise(value).alias(name)
    return rows.select(
        "doc_id", "document_type", "needs_retake", F.when(F.col("_unknown"), ~F.col("needs_retake")).when(F.col("_lost"), no).otherwise(review).alias("needs_manual_review"),
        open_(F.col("matched") & ~F.col("_incomplete") & ~bad, no, "matched"), open_(F.when(bad, F.lit(0.0)).otherwise(F.col("confidence")), F.lit(0.0), "confidence"),
        open_(F.col("name_match"), no, "name_match"), open_(F.col("id_match"), no, "id_match"), open_(F.col("dob_match"), no, "dob_match"), "front_back_match",
        open_(F.col("_expired"), no, "document_expired"), open_(F.col("full_name"), F.lit(None), "extracted_name"), open_(F.col("number"), F.lit(None), "extracted_id_number"),
        open_(F.date_format("born", "dd.MM.yyyy"), F.lit(None), "extracted_dob"), open_(F.date_format("expires", "dd.MM.yyyy"), F.lit(None), "extracted_expiry"),
        reason.alias("reject_reason"),
    )


def text_agreement(fields, keys=("doc_id",)):
    """Mean similarity of read text to the true text per frame, letters and digits only."""
    clean = lambda c: F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z0-9]", "")
    return fields.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fields"), F.round(F.avg(x.similarity(clean("read_text"), clean("true_text"))), 4).alias("agreement")
    )
