"""Column functions of the evidence model: keys, cleaning, normal forms and classifiers.

All are expressions of built-in functions, so they stay inside code generation
and can be pushed below joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Grams in a mass unit, fixed values.
GRAMS = {"ug": 1e-6, "mg": 1e-3, "g": 1.0, "kg": 1000.0}
#: Lower bounds in grams of the scale bands, fixed values.
BANDS = ((100000.0, "manufacturing"), (10000.0, "pilot"), (100.0, "kilo_lab"), (1.0, "laboratory"), (0.0, "sub_gram"))
#: Order in which kinds of mass may be the basis of a scale, fixed values.
BASIS = ("product_mass", "batch_mass", "limiting_reagent_mass", "input_mass")
#: Confidence of a match by the whole key and by its connectivity part, fixed values.
CONFIDENCE = {"exact_structure": 0.98, "same_connectivity": 0.85}
#: Patterns of identifiers, fixed values.
KEY_PATTERN, CONNECTIVITY_PATTERN, HASH_PATTERN = "^[A-Z]{14}-[A-Z]{10}-[A-Z]$", "^[A-Z]{14}$", "^[0-9a-f]{64}$"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Without white space at the ends; null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def normalize_name(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 24 hex digits of the SHA-256 of the parts joined by ``|``; a null part is empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 24))


def job_id(kind: Column, identity: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.char(F.lit(0)), identity), 256), 1, 24)


def zfill(text: Column, width: int) -> Column:
    """Padded with zeros from the left; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def split_list(text: Column, pattern: str = ";") -> Column:
    """Trimmed parts that are not blank."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def split_pair(text: Column, mark: str = ";") -> tuple[Column, Column]:
    """What stands before the first mark and after it, both cleaned."""
    at = F.instr(text, mark)
    return clean(F.substring_index(text, mark, 1)), clean(F.when(at > 0, F.substr(text, at + len(mark))))


def publication_dashed(text: Column) -> Column:
    """``CC-NUMBER-KIND`` of a publication number, else null.

    Spaces and slashes separate like dashes; numbers may begin with letters
    (design and reissue numbers).  Without separators the kind needs its digit,
    else it could not be told from the number.
    """
    t = F.regexp_replace(F.upper(clean(text)), r"[\s/-]+", "-")
    whole, joined = "^([A-Z]{2})-([A-Z0-9]+)-([A-Z][0-9]?)$", "^([A-Z]{2})([A-Z0-9]+?)([A-Z][0-9])$"
    close = F.replace(t, F.lit("-"), F.lit(""))
    # what matches is rewritten whole, what does not stays as it is
    dashed = F.regexp_replace(close, joined, "$1-$2-$3")
    return F.when(t.rlike(whole), t).when(dashed.contains("-"), dashed)


def publication_compact(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def family_id(family: Column, publication: Column) -> Column:
    """Family of a snapshot; a missing one (null, blank, -1) falls back on the publication."""
    f = clean(family.cast("string"))
    return F.when(f.isNull() | (f == "-1"), F.concat(F.lit("surechembl-publication:"), publication)).otherwise(F.concat(F.lit("surechembl:"), f))


def marketing_status(text: Column) -> Column:
    """withdrawn, discontinued, tentative, active or unknown; the first that the description, as a normalised name, fits."""
    t = normalize_name(text)
    return (
        F.when(t.contains("withdraw"), "withdrawn")
        .when(t.contains("discont") | (t == "discn"), "discontinued")
        .when(t.contains("tentative"), "tentative")
        .when(t.isin("rx", "otc") | t.contains("prescription") | t.contains("over the counter"), "active")
        .otherwise("unknown")
    )


def grams(value: Column, unit: Column) -> Column:
    """Mass in grams; null for units that are none and for negative or missing values."""
    factor = F.coalesce(*[F.when(F.lower(unit) == u, F.lit(g)) for u, g in GRAMS.items()])
    return F.when((value >= 0) & ~F.isnan(value), value * factor)


def scale_band(mass: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for low, name in BANDS:
        out = out.when(mass >= low, name)
    return out.otherwise("unknown")


def basis_rank(kind: Column) -> Column:
    """0 for the kind that comes first; null for kinds that are no basis."""
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(BASIS)])


def bucket(group: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and group alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), group), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def split_name(at: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    return F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")


def confidence(match_type: Column) -> Column:
    return F.coalesce(*[F.when(match_type == k, F.lit(v)) for k, v in CONFIDENCE.items()])


def namespace(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"))


def media_type(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.endswith(".json") | p.endswith(".jsonl"), "application/json").when(p.endswith(".csv"), "text/csv").when(p.endswith(".parquet"), "application/vnd.apache.parquet")
        .when(p.endswith(".zip"), "application/zip").when(p.endswith(".pdf"), "application/pdf").when(p.endswith(".txt"), "text/plain").otherwise("application/octet-stream")
    )


def looks_like_structure(text: Column) -> Column:
    return text.rlike(r"[=()\[\]#]")


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def finite(text: Column) -> Column:
    """The number that a text states; null for none, NaN and infinities."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _sorted_fields(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_sorted_fields(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _sorted_fields(e["value"], kind.valueType))))
    return c


def canonical_json(rows: DataFrame, *names: str) -> Column:
    """The named columns of ``rows`` as a JSON object with its keys in order on every level; nulls are written."""
    fields = {f.name: f.dataType for f in rows.schema.fields}
    return F.to_json(F.struct(*[_sorted_fields(F.col(n), fields[n]).alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms the text contains."""
    out = F.lit(0)
    for t in terms:
        out = out + text.contains(t).cast("int")
    return out


def any_phrase(text: Column, phrases: Column, least: int = 5) -> Column:
    """Whether a normalised text contains one of an array of normalised phrases of ``least`` characters or more as whole words."""
    return F.exists(phrases, lambda p: has_phrase(text, p, least))


def query_kind(text: Column) -> Column:
    """What a search asks for: a structure if it has characters of one, an identifier key, else a name."""
    key = F.upper(clean(text))
    return F.when(key.rlike(KEY_PATTERN), "inchi_key").when(looks_like_structure(text), "structure").otherwise("name")


def quote_found(source: Column, quote: Column) -> Column:
    """Whether a quotation stands in its source, word for word; an empty one does not."""
    return (F.length(quote) > 0) & (F.instr(source, quote) > 0)


def release_label(path: Column) -> Column:
    """Name of a candidate release: the folder that a file lies in and how it was made."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.concat(F.lit("surechembl-"), folder, F.when(folder.contains("large-chemical"), "-delta").otherwise("-ranked-local"))


def synonym_value(row: dict[str, Column], *names: str) -> Column:
    """The first of the named columns that is there and not blank; header names count in their normal form."""
    import re

    plain = lambda n: re.sub("[^a-z0-9]+", " ", n.lower()).strip()
    have = {plain(n): c for n, c in row.items()}
    found = [clean(have[plain(n)]) for n in names if plain(n) in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def has_phrase(text: Column, phrase: Column, least: int = 5) -> Column:
    """Whether a normalised text contains a normalised phrase of ``least`` characters or more as whole words."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (F.length(phrase) >= least) & pad(text).contains(pad(phrase))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds; a null condition does not hold; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])
