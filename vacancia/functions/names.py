"""Company and role names as comparison keys.

Several keys exist on purpose: each consumer folds names in its own way, and merging the variants
would change which rows meet.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import fold, strip_accents
from .patterns import WORD_EDGE, java_pattern

# Generic words of company names, one list per key.
GENERIC_COMPANY = [
    "inc", "llc", "ltd", "ltda", "gmbh", "co", "corp", "corporation", "company", "the", "games", "game",
    "studio", "studios", "interactive", "entertainment", "media", "group", "holdings", "productions", "sarl",
    "sa", "bv", "ab", "oy", "as", "plc", "limited", "sl", "srl", "kk", "pte", "pty", "ug", "gaming",
]
TRACK_NOISE = [
    "studio", "studios", "games", "game", "interactive", "entertainment", "entertaiment", "inc", "llc", "ltd",
    "limited", "corp", "company", "co", "gmbh", "ab", "oy", "as", "bv", "sa", "srl", "sl", "group", "the",
    "productions", "media",
]
BOARD_SUFFIXES = [" inc.", " inc", " llc", " ltd", " corp", " corporation", " technologies", " technology",
                  " group", " co."]
_MINE_NOISE = r"\b(ab|inc|ltd|llc|gmbh|studios?|games?|interactive|entertainment|group|the|co)\b"
_MINE_GLUED = "(ltd|llc|gmbh|studios?|interactive|entertainment|group|games?)"
_IMPORT_NOISE = (r"\b(ab|aktiebolag|inc|ltd|llc|gmbh|hb|as|aps|oy|studios?|games?|interactive|entertainment|group"
                 r"|the|productions?|media)\b")
_PROBE_NOISE = r"\b(ab|inc|ltd|llc|studios?|games?|interactive|entertainment|group|the)\b"
_SLUG_NOISE = r"\b(studios?|games?|interactive|entertainment|the|group)\b"
_CORE_NOISE = (r"\b(studios?|games?|interactive|entertainment|productions?|software|digital|media|works|limited"
               r"|company|corporation|corp|inc|ltd|llc|co|gmbh|ab|oy|sa|bv|the)\b")
_WEB_ENDING = r"\.(net|com|io|gg|co|dev|games|studio|world|gl|ai|xyz|tv)$"


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, java_pattern(pattern), by)


def alnum_key(c: Column) -> Column:
    """Letters and digits only (tracker merge, integrity checks)."""
    return F.regexp_replace(_lower(c), "[^a-z0-9]", "")


def spaced_key(c: Column) -> Column:
    """Letters, digits and single blanks (tracker clusters)."""
    flat = F.regexp_replace(F.regexp_replace(_lower(c), "[()]", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(flat, "[^a-z0-9 ]", ""))


def board_key(c: Column) -> Column:
    """Legal and trade suffixes cut one after the other from the end (dashboard joins)."""
    s = F.trim(_lower(c))
    for suffix in BOARD_SUFFIXES:
        s = F.regexp_replace(s, suffix.replace(".", r"\.") + r"\z", "")
    return F.trim(s)


def mine_key(c: Column) -> Column:
    """Noise words dropped both as words and glued to others (board mining)."""
    return F.regexp_replace(F.regexp_replace(_drop(_lower(c), _MINE_NOISE), "[^a-z0-9]", ""), _MINE_GLUED, "")


def track_key(c: Column) -> Column:
    """Accent-free words without noise words, joined by blanks (tracked-company lookup)."""
    words = F.split(F.regexp_replace(strip_accents(_lower(c)), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(TRACK_NOISE)), " ")


def import_key(c: Column) -> Column:
    """Accent-free letters and digits without noise words (directory imports)."""
    return F.regexp_replace(_drop(strip_accents(_lower(c)), _IMPORT_NOISE), "[^a-z0-9]+", "")


def probe_key(c: Column) -> Column:
    """Letters and digits without noise words, accents kept out (coverage ledger)."""
    return F.regexp_replace(_drop(_lower(c), _PROBE_NOISE), "[^a-z0-9]+", "")


def lookup_key(c: Column) -> Column:
    """Lower case with single blanks (company lookup)."""
    return F.trim(F.regexp_replace(_lower(c), r"\s+", " "))


def core_name(c: Column) -> Column:
    """Lookup key without web ending and trade words; never empty."""
    base = F.regexp_replace(lookup_key(c), _WEB_ENDING, "")
    core = F.trim(F.regexp_replace(F.regexp_replace(_drop(base, _CORE_NOISE, " "), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return F.when(core == "", lookup_key(c)).otherwise(core)


def core_tokens(c: Column) -> Column:
    """Significant words of a folded company name, generic words left out."""
    return F.filter(F.split(fold(c), " "), lambda t: (t != "") & ~t.isin(GENERIC_COMPANY))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def name_slugs(c: Column) -> Column:
    """Distinct slug candidates of at least four characters."""
    base = F.trim(F.regexp_replace(_lower(c), r"\(.*?\)", ""))
    hyphen = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-|-$", "")
    bare = F.regexp_replace(_drop(base, _SLUG_NOISE), "[^a-z0-9]+", "")
    return F.array_distinct(F.filter(F.array(F.regexp_replace(base, "[^a-z0-9]+", ""), hyphen, bare),
                                     lambda s: F.length(s) >= 4))


def domain_guesses(c: Column, endings: list[str]) -> Column:
    low = _lower(c)
    whole = F.regexp_replace(F.regexp_replace(low, r"\(.*?\)", ""), "[^a-z0-9]+", "")
    bare = F.regexp_replace(_drop(low, _SLUG_NOISE), "[^a-z0-9]+", "")
    stems = F.array_distinct(F.filter(F.array(whole, bare), lambda s: F.length(s) >= 3))
    return F.flatten(F.transform(stems, lambda s: F.transform(
        F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(s, F.lit("."), e))))


# --- role words -------------------------------------------------------------------------------

# Words of role titles that carry no signal, for the two role comparisons.
MERGE_STOP = [
    "junior", "mid", "middle", "senior", "staff", "principal", "lead", "head", "chief", "associate", "intern",
    "entry", "level", "remote", "hybrid", "onsite", "contract", "contractor", "freelance", "fulltime",
    "parttime", "permanent", "temporary", "internship", "role", "position", "opportunity", "team", "based",
    "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "pune", "chennai", "london", "berlin", "paris",
    "madrid", "barcelona", "amsterdam", "dublin", "york", "francisco", "seattle", "boston", "austin", "chicago",
    "toronto", "tokyo", "singapore", "sydney", "melbourne", "lisbon", "warsaw", "europe", "emea", "apac",
    "latam", "americas", "india", "spain", "germany", "france", "italy", "canada", "brazil", "mexico", "japan",
    "with", "from", "into", "over", "this", "that",
]
SHORT_SPECIALTY = ["api", "sre", "sdk", "cli", "gpu", "cpu", "ios", "qa", "ux", "ui", "ar", "vr", "ocr", "crm", "erp"]
BASELINE = [
    "software", "engineer", "developer", "manager", "architect", "analyst", "designer", "consultant",
    "specialist", "platform", "systems", "services", "backend", "frontend", "fullstack",
]
CLUSTER_STOP = [
    "senior", "junior", "lead", "staff", "principal", "head", "chief", "manager", "director", "associate",
    "intern", "contractor", "remote", "hybrid", "onsite", "engineer", "engineering", "tokyo", "japan", "london",
    "berlin", "paris", "singapore", "york", "francisco", "angeles", "seattle", "austin", "boston", "chicago",
    "denver", "toronto", "amsterdam", "dublin", "sydney", "global", "emea", "apac", "latam",
]


def merge_role_words(role: Column) -> Column:
    words = F.split(F.regexp_replace(_lower(role), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: ((F.length(w) > 3) | w.isin(SHORT_SPECIALTY)) & ~w.isin(MERGE_STOP))


def cluster_role_words(role: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(_lower(role), "[()]", " "), r"\s+", " ")
    words = F.split(F.trim(F.regexp_replace(flat, "[^a-z0-9 /]", "")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(CLUSTER_STOP))


def shared_words(a: Column, b: Column) -> Column:
    """Words of ``a`` present in ``b``; a word repeated in ``a`` counts each time."""
    return F.filter(a, lambda w: F.array_contains(b, w))


def role_words_match(a: Column, b: Column, baseline: list[str] | None = None) -> Column:
    """Two shared words and 60 % of the smaller side; with ``baseline`` one must lie outside it."""
    shared = shared_words(a, b)
    hit = (F.size(shared) >= 2) & (F.size(shared) >= 0.6 * F.least(F.size(a), F.size(b)))
    if baseline is not None:
        hit = hit & F.exists(shared, lambda w: ~w.isin(baseline))
    return hit


def with_same_role(df, left: str, right: str, out: str, words=merge_role_words, baseline: list[str] | None = BASELINE):
    """Add ``out``: do two role columns denote one role? Words are projected once before they are compared."""
    cols = df.columns
    split = df.withColumns({"_left": words(F.col(left)), "_right": words(F.col(right))})
    return split.select(*cols, role_words_match(F.col("_left"), F.col("_right"), baseline).alias(out))


def guard_columns(prefix: str, company: Column, aliases: list[list[str]] | None = None) -> dict[str, Column]:
    """Columns that :func:`company_compatible` compares; project them once per side."""
    return {f"{prefix}_fold": fold(company), f"{prefix}_alias": alias_fold(company, aliases), f"{prefix}_core": core_tokens(company)}


def company_compatible(left: str, right: str) -> Column:
    """Names that may denote one employer: equal fold or alias, word subset, or initials.

    ``left`` and ``right`` are the prefixes given to :func:`guard_columns`.
    """
    ca, cb = F.col(f"{left}_core"), F.col(f"{right}_core")
    worded = (F.size(ca) > 0) & (F.size(cb) > 0)
    inside = (F.size(F.array_except(ca, cb)) == 0) | (F.size(F.array_except(cb, ca)) == 0)
    letters = ((F.size(ca) == 1) & (F.get(ca, F.lit(0)) == initials(cb))) | ((F.size(cb) == 1) & (F.get(cb, F.lit(0)) == initials(ca)))
    known = (F.col(f"{left}_fold") != "") & (F.col(f"{right}_fold") != "")
    return known & ((F.col(f"{left}_alias") == F.col(f"{right}_alias")) | (worded & (inside | letters)))


def alias_fold(c: Column, aliases: list[list[str]] | None = None) -> Column:
    """Folded name mapped to the first name of its alias group."""
    import re
    table: dict[str, str] = {}
    for group in aliases or []:
        names = [n for n in (re.sub(r"[\W_]+", " ", g.lower()).strip() for g in group) if n]
        for name in names:
            table[name] = names[0]
    if not table:
        return fold(c)
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), fold(c))
    return F.coalesce(mapped, fold(c))


def city_compatible(a: Column, b: Column) -> Column:
    from .text import first_segment_fold
    pa, pb = first_segment_fold(a), first_segment_fold(b)
    return (pa == "") | (pb == "") | (pa == pb)
