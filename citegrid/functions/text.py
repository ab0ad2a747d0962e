"""Column functions that clean and key the text fields of publication records.

Everything is built from Spark's own functions except the two Unicode decompositions, which Spark lacks: those run as Arrow
UDFs, to which ASCII values are nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's re module sees it in text.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Words that title blocks skip.
TITLE_STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with")
#: What a number looks like in an export.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Strings that an export uses for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Names of Greek letters.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}
#: Plural forms that terms and texts share with a singular.
SINGULAR = {"mutations": "mutation", "variations": "variation", "defects": "defect"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def _to_ascii(s: pd.Series) -> pd.Series:
    """NFKD, then everything that is not ASCII is dropped."""
    return s.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def _fold(s: pd.Series) -> pd.Series:
    """NFKC, casefold, Greek letters by name, NFKD without combining marks."""

    def fold(v: str) -> str:
        v = unicodedata.normalize("NFKC", v).casefold()
        for letter, name in GREEK.items():
            if letter in v:
                v = v.replace(letter, f" {name} ")
        return "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))

    return s.map(fold, na_action="ignore")


def _strip_to_ascii(c: Column) -> Column:
    return F.pandas_udf(_to_ascii, "string")(c)  # made here, as workers import this module without a session


def _fold_terms(c: Column) -> Column:
    return F.pandas_udf(_fold, "string")(c)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fix_encoding(c: Column | str) -> Column:
    """Undo UTF-8 read as Latin-1; a text that does not decode that way stays as it is."""
    c = col(c)
    suspect = c.rlike(r"^[\x00-\xff]*$") & c.rlike(r"[\x80-\xff]")
    return F.when(suspect, F.coalesce(F.try_validate_utf8(F.encode(F.when(suspect, c), "ISO-8859-1").cast("string")), c)).otherwise(c)


def squeeze(c: Column | str) -> Column:
    """Encoding repaired, runs of white space to one blank, trimmed; null to empty."""
    return F.trim(F.regexp_replace(fix_encoding(F.coalesce(col(c).cast("string"), F.lit(""))), SPACE, " "))


def plain(c: Column | str) -> Column:
    """As squeeze, without the repair of encoding."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), SPACE, " "))


def lookup_key(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits with single blanks between them: the key that names and titles share."""
    s = squeeze(c)
    folded = F.coalesce(_strip_to_ascii(F.when(~_ascii(s), s)), s)  # ASCII values reach the UDF as nulls
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def ascii_key(c: Column | str) -> Column:
    """lookup_key for texts that are known to be ASCII; no UDF in the plan."""
    return F.trim(F.regexp_replace(F.lower(plain(c)), "[^a-z0-9]+", " "))


def tokens(key: Column | str) -> Column:
    """Words of a key; an empty key has none."""
    return F.array_remove(F.split(col(key), " "), "")


def title_block(key: Column | str) -> Column:
    """The first two words of a title's key that are not stopwords, else its first two words; 32 characters at most."""
    words = tokens(key)
    chosen = F.filter(words, lambda w: ~w.isin(*TITLE_STOPWORDS))
    return F.substring(F.array_join(F.slice(F.when(F.size(chosen) > 0, chosen).otherwise(words), 1, 2), " "), 1, 32)


def first_key(*keys: Column) -> Column:
    """The first key that is not empty."""
    return F.coalesce(*[F.nullif(k, F.lit("")) for k in keys], F.lit(""))


def number(c: Column | str) -> Column:
    """A plain decimal number as double, else null."""
    c = col(c).cast("string")
    return F.when(c.rlike(NUMBER), c).try_cast("double")


def year_key(c: Column | str) -> Column:
    return F.coalesce(number(c).cast("int").cast("string"), F.lit(""))


def doi_key(c: Column | str) -> Column:
    """Without quotes, resolver address or prefix, and closing marks; lower case."""
    s = F.btrim(squeeze(c), F.lit(" \t\r\n\"'“”‘’"))
    s = F.regexp_replace(s, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)", "")
    return F.lower(F.regexp_replace(F.trim(s), r"[.,;]+$", ""))


def clean_author(c: Column | str) -> Column:
    s = F.regexp_replace(squeeze(c), r"\s*\(\s*\d{5,}\s*\)\s*", "")
    s = F.regexp_replace(s, r"\s*\[[^\]]*\]\s*", "")
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" ;,|"))


def author_id(c: Column | str) -> Column:
    """The first run of five or more digits."""
    return F.regexp_extract(squeeze(c), r"\d{5,}", 0)


def author_list(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(squeeze(c), ";"), clean_author), lambda x: x != "")


def author_id_list(c: Column | str) -> Column:
    """Positional: blanks stay."""
    s = squeeze(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(s, ";"), author_id))


def align_ids(authors: Column, ids: Column) -> Column:
    """ids cut or filled with blanks to the number of authors."""
    n = F.size(authors)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(F.concat(ids, F.array_repeat(F.lit(""), n)), F.lit(1), n))


def order_key(key: Column | str) -> Column:
    """The sorted words of a key."""
    return F.array_join(F.array_sort(tokens(key)), " ")


def identity_key(key: Column | str) -> Column:
    """Identity of an author from the key of the name; ids do not count."""
    k = order_key(key)
    return F.when(k == "", "").otherwise(F.concat(F.lit("name:"), k))


def surname_key(name: Column | str) -> Column:
    """Key of what stands before a comma, else of the last word."""
    s = clean_author(name)
    before = F.when(F.contains(s, F.lit(",")), F.substring_index(s, ",", 1)).otherwise(F.substring_index(s, " ", -1))
    return lookup_key(before)


def clean_affiliation(c: Column | str) -> Column:
    pairs = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))

    def bare(s: Column) -> Column:
        quoted = F.lit(False)
        for a, b in pairs:
            quoted = quoted | (s.startswith(a) & s.endswith(b))
        return F.when((F.length(s) >= 2) & quoted, F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)

    s = let(squeeze(c), bare)
    s = F.regexp_replace(F.regexp_replace(s, r"\s*,\s*", ", "), r",\s*,+", ", ")
    return F.btrim(s, F.lit(" ,;|"))


def components(affiliation: Column | str) -> Column:
    return F.filter(F.transform(F.split(clean_affiliation(affiliation), ","), clean_affiliation), lambda x: x != "")


def affiliations(c: Column | str) -> Column:
    """array<struct<raw_affiliation, components>> of a field that separates affiliations by semicolons."""
    raw = F.filter(F.transform(F.split(squeeze(c), ";"), clean_affiliation), lambda x: x != "")
    return F.transform(raw, lambda a: F.struct(a.alias("raw_affiliation"), components(a).alias("components")))


#: Types of affiliation components, and the spellings of a reviewer's verdict on them.
COMPONENT_TYPES = ("institution", "city", "country", "exclude")
ACCEPTED, REJECTED = ("accept", "accepted", "yes", "y", "true", "1"), ("reject", "rejected", "no", "n", "false", "0")


def component_type(c: Column | str) -> Column:
    k = lookup_key(c)
    return F.when(k.isin(*COMPONENT_TYPES), k).otherwise("")


def decision(c: Column | str) -> Column:
    k = lookup_key(c)
    return F.when(k.isin(*ACCEPTED), "accept").when(k.isin(*REJECTED), "reject").otherwise("unresolved")


#: Words of notices about other publications.
RETRACTIONS = ("retraction", "retracted", "withdrawal", "withdrawn")
CONCERN = "expression of concern"
CORRECTIONS = ("correction", "erratum", "corrigendum")


def notice_type(title_and_type_key: Column) -> Column:
    w = tokens(title_and_type_key)
    has = lambda *names: F.arrays_overlap(w, F.array(*map(F.lit, names)))
    return (
        F.when(has(*RETRACTIONS), "retraction")
        .when(F.contains(title_and_type_key, F.lit(CONCERN)), "expression_of_concern")
        .when(has(*CORRECTIONS), "correction_or_erratum")
        .otherwise("")
    )


#: How a record says that it is not open, that it is, and by which route.
NOT_OPEN = ("", "no", "none", "closed", "closed access", "no open access", "not open access", "non open access", "false", "0")
OPEN, ROUTES = ("yes", "true", "1"), ("gold", "green", "bronze", "hybrid")


def open_access_affirmative(c: Column | str) -> Column:
    """Does a merged record count as open: denials first, then plain assent, the phrase, or a route's name."""
    k = lookup_key(c)
    denied = k.isin(*NOT_OPEN)
    route = F.arrays_overlap(tokens(k), F.array(*map(F.lit, ROUTES)))
    return ~denied & (k.isin(*OPEN) | F.contains(k, F.lit("open access")) | route)


def open_access_status(c: Column | str) -> Column:
    return F.when(F.contains(F.lower(plain(c)), F.lit("all open access")), "Open Access").otherwise("Not Open Access")


def split_values(c: Column | str, pattern: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), pattern), squeeze), lambda x: x != "")


def present(c: Column | str) -> Column:
    return squeeze(c) != ""


def term_key(c: Column | str) -> Column:
    """Key of dictionary terms and of the texts they are looked up in: letters and digits apart, three plurals made singular."""
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    folded = F.coalesce(_fold_terms(F.when(~_ascii(s), s)), F.lower(s))  # ASCII values reach the UDF as nulls
    return _term_words(folded)


def ascii_term_key(c: Column | str) -> Column:
    return _term_words(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))))


def _term_words(folded: Column) -> Column:
    s = F.regexp_replace(folded, r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    words = F.array_remove(F.split(F.regexp_replace(s, "[^a-z0-9]+", " "), " "), "")

    def single(w: Column) -> Column:
        out = w
        for many, one in SINGULAR.items():
            out = F.when(w == many, one).otherwise(out)
        return out

    return F.array_join(F.transform(words, single), " ")


def first_per_key(items: Column, key) -> Column:
    """Items of an array with the first of each key(item), in order; blank keys are dropped."""
    keyed = F.filter(F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v"))), lambda s: s["k"] != "")

    def unseen(all_: Column) -> Column:
        keys = F.transform(all_, lambda s: s["k"])
        return let(keys, lambda ks: F.transform(F.filter(F.transform(all_, lambda s, i: F.struct(s["v"].alias("v"), (F.array_position(ks, s["k"]) == i + 1).alias("first"))), lambda s: s["first"]), lambda s: s["v"]))

    return let(keyed, unseen)
