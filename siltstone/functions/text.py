"""Column functions over strings: tokens, normal forms, similarity, keyword labels. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of code that carry no meaning for retrieval.
STOPWORDS = (
    "def class return import from self cls the a an is are was were be been to of in on for with and or not if else elif while try except "
    "finally as pass break continue lambda yield global nonlocal assert del raise fn let mut pub impl struct enum trait mod "
    "use match where ref move const static type async await box dyn"
).split()
# Keywords of each kind of claim; the first kind with a keyword in the text is the claim's.
CLAIM_KINDS = [
    ("invariant", "must|shall|invariant|guarantee|required|never|always"),
    ("concurrency", "thread-safe|atomic|lock|mutex|concurrent"),
    ("security", "security|encrypt|vulnerable"),
    ("complexity", r"o\(|complexity|linear|constant time|logarithmic"),
    ("performance", "performance|fast|slow|latency|throughput"),
    ("error_behavior", "retr|raise|throw|exception|error|fail"),
    ("side_effect", "side effect|mutates|writes|logs|prints"),
    ("ordering", "before|after|order|sequence|then"),
    ("public_contract", "param|argument|return|signature|public"),
    ("rationale", "because|rationale|reason|why|historically"),
    ("external_dependency", "external|remote|protocol|service|api"),
]
# Words that show how strongly a claim binds.
MODALITIES = [
    ("non_checkable", r"\b(because|historically|previously|rationale|reason|legacy|originally)\b"),
    ("existential", r"\b(exactly|at least|at most|up to|once|twice|some)\b"),
    ("conditional", r"\b(if|when|unless|may|might|could|only)\b"),
]
# What an end-of-run message says went wrong; the first pattern that occurs decides.
TERMINAL_REASONS = [
    ("OVERSIZED", "too large|oversized"),
    ("NO_CONFLICT", "no conflict|skipped"),
    ("CASE_TIMEOUT", "case timeout"),
    ("WALL_TIME", "wall-time|wall_time"),
    ("MODEL_NEEDS_HUMAN", "needs_human"),
    ("MODEL_EMPTY", "empty res"),
    ("WHOLE_FILE_FAILED", "whole-file|whole_file"),
    ("PROOF_NO_PROGRESS", "convergence.*(stalled|unaccounted)|(stalled|unaccounted).*convergence"),
    ("CARGO_NO_PROGRESS", "convergence|could not resolve.*(error:|syntax|delimiter)|(error:|syntax|delimiter).*could not resolve"),
    ("MODEL_EMPTY", "could not resolve"),
]
# File endings by language.
LANGUAGES = {"py": "python", "pyi": "python", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "toml": "toml", "json": "json", "md": "markdown", "html": "html"}


def ident_tokens(c: Column) -> Column:
    """Lower-case terms of identifiers: camel case and snake case split; numbers, single letters and stopwords dropped."""
    return F.filter(F.transform(ident_parts(c), F.lower), is_term)


def ident_parts(c: Column) -> Column:
    """The parts of identifiers as they are written."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z0-9_])|[0-9]+"), 0)


def is_term(t: Column) -> Column:
    """Whether a lower-case part is a term: no single letter, number or stopword. On exploded rows this is compiled; in arrays it isn't."""
    return (F.length(t) > 1) & ~t.rlike("^[0-9]") & ~t.isin(STOPWORDS)


def words(c: Column) -> Column:
    """Distinct lower-case words, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))


def squeezed(c: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def squeezed_lines(c: Column) -> Column:
    """Each line squeezed, blank lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), squeezed), lambda x: x != ""), "\n")


def fact(c: Column) -> Column:
    """A claim's canonical text: squeezed, lower case, without trailing ``.,;:``."""
    return F.regexp_replace(F.lower(squeezed(F.coalesce(c, F.lit("")))), "[.,;:]+$", "")


def resolved(c: Column) -> Column:
    """Text for comparison of results: no space around punctuation, single spaces elsewhere."""
    return squeezed(F.regexp_replace(c, r"\s*([^\w\s])\s*", "$1"))


def is_correct(candidate: Column, expected: Column) -> Column:
    """The candidate contains the expected text; an empty expectation is never met."""
    e = resolved(F.coalesce(expected, F.lit("")))
    return F.when(e == "", F.lit(False)).otherwise(resolved(F.coalesce(candidate, F.lit(""))).contains(e))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4))).otherwise(F.lit(0)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def first_match(c: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that occurs in the text, lower-cased."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out: Column | None = None
    for label, pattern in table:
        hit = low.rlike("(?s)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def claim_kind(c: Column) -> Column:
    return first_match(c, CLAIM_KINDS, "implementation_description")


def claim_modality(c: Column) -> Column:
    return first_match(c, MODALITIES, "universal")


def terminal_reason(c: Column) -> Column:
    return first_match(c, TERMINAL_REASONS, "OTHER")


def language_of(path: Column) -> Column:
    """Language by a path's ending, or null."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def has_markers(c: Column) -> Column:
    """Some line starts with a conflict marker."""
    return F.coalesce(c, F.lit("")).rlike(r"(?m)^(<<<<<<<|=======|>>>>>>>)")


def channel(line: Column) -> Column:
    """directive, comment, formatting or executable; a directive is recognised before a comment."""
    return (
        F.when(F.trim(line) == "", "formatting")
        .when(line.rlike(r"^\s*(#!?\[|@[A-Za-z])"), "directive")
        .when(line.rlike(r"^\s*(//|#|/\*|\*/|\*)"), "comment")
        .when(line.rlike(r"^[\s{}()\[\];,]*$"), "formatting")
        .otherwise("executable")
    )


def anchor(line: Column) -> Column:
    """What a line of code is about: the path of an import, else its leading identifier."""
    path = F.regexp_extract(line, r"^\s*(?:pub\s+)?(?:use\s+|import\s+|from\s+|#include\s+)(.+?)\s*(?:;|::\{|\s+as\s|$)", 1)
    name = F.regexp_extract(line, r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?(?:fn\s+|def\s+|class\s+|struct\s+|enum\s+|impl\s+)?([A-Za-z_]\w*)", 1)
    return F.when(path != "", path).otherwise(name)


def version_key(v: Column) -> Column:
    """Sortable struct of a version: numeric parts compare as numbers, a release comes after its pre-releases, what isn't a version comes first."""
    core = F.regexp_extract(v, r"^[0-9.]+", 0)
    rest = F.substring(v, F.length(core) + 1, F.length(v))
    nums = F.transform(F.filter(F.split(core, "[.]"), lambda x: x != ""), lambda x: x.try_cast("long"))
    return F.struct((core != "").cast("int").alias("numeric"), F.when(core != "", nums).alias("parts"), (rest == "").cast("int").alias("release"), F.when(core != "", rest).otherwise(v).alias("rest"))


def masked(c: Column) -> Column:
    """A body for comparison of meanings: quoted literals as ``<STR>``, comments to the end of a line dropped, white space squeezed."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "\"[^\"\n]*\"|'[^'\n]*'", "<STR>")
    return squeezed(F.regexp_replace(plain, r"(?m)(#|//).*$", ""))


def content_key(*cols: Column) -> Column:
    """A short address of a row's texts: the first 16 hex digits of the SHA-256 of their JSON array."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in cols])), 256), 1, 16)


def record_hash(**cols: Column) -> Column:
    """SHA-256 of a record that doesn't depend on the order of its fields: nulls as empty, fields by name."""
    return F.sha2(F.concat_ws("\u0001", *[F.concat(F.lit(k + "="), F.coalesce(cols[k].cast("string"), F.lit(""))) for k in sorted(cols)]), 256)
