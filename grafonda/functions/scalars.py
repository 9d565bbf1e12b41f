"""Scalar functions as Column expressions; times are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in hours by memory tier, words that say nothing in searches.
HALF_LIVES = {"session_log": 72.0, "project": 336.0}
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by", "at", "from", "that", "this", "be")


def micros(at: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def split_camel_all(s: Column) -> Column:
    """A blank before every capital but a first one: "HTTPGet" gives "H T T P Get"."""
    return F.regexp_replace(s, "(?<!^)([A-Z])", " $1")


def camel_words(s: Column) -> Column:
    """Lower-case words of an identifier, acronyms kept whole: "BFSCarver" gives [bfs, carver]."""
    return F.filter(F.split(F.lower(F.regexp_replace(s, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")), r"[\s_.\-/]+"), lambda w: w != "")


def normalized_name(s: Column) -> Column:
    return F.lower(F.translate(s, "-_./", ""))


def knowledge_name(s: Column) -> Column:
    return F.lower(F.trim(s))


def token_set(s: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(s), r"[^\p{L}\p{Nd}]+")), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def ir_tokens(s: Column) -> Column:
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def without_model_date(s: Column) -> Column:
    return F.regexp_replace(s, r"-(\d{8}|\d{4}-\d{2}-\d{2})$", "")


def recency_decay(age_hours: Column, accesses: Column, half_life: Column | float = 168.0) -> Column:
    """1 / (1 + age / (half-life * log2(max(accesses, 1) + 1))); ages under 0 count as 0."""
    life = F.lit(half_life) if isinstance(half_life, float) else half_life
    return 1 / (1 + F.greatest(age_hours, F.lit(0.0)) / (life * F.log2(F.greatest(accesses, F.lit(1)) + 1)))


def tier_half_life(tier: Column, manual: Column) -> Column:
    return F.when(tier == "session_log", HALF_LIVES["session_log"]).when(tier == "project", HALF_LIVES["project"]).when((tier == "entity") & manual, 504.0).otherwise(168.0)


def admission_importance(source: Column, most_similar: Column) -> Column:
    prior = F.when(source == "auto", 0.8).when(source == "failure", 1.4).when(source.isin("pattern", "rule"), 1.2).otherwise(1.0)
    new = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1 - most_similar))
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), prior * new))


def context_confidence(quality: Column, signals: Column, fresh: Column, stale: Column) -> Column:
    base = F.when(signals == 0, 0.75).otherwise(0.15 + 0.8 / (1 + F.exp(-quality / 2)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.when(fresh, 0.10).otherwise(0.0) - F.when(stale, 0.05).otherwise(0.0))), 2)


def quality_boost(quality: Column) -> Column:
    return 1 + 0.2 * F.tanh(quality / 5)


def hop_estimate(relevance: Column, decay: float) -> Column:
    return F.round(F.abs(F.log(relevance) / F.log(F.lit(decay)))).cast("int")


def token_estimate(s: Column) -> Column:
    return F.floor(F.octet_length(s) / 4) + 1


def presence(minutes: Column) -> Column:
    return F.when(minutes <= 8, "active").when(minutes <= 15, "idle").otherwise("inactive")


def blame_age(days: Column) -> Column:
    return F.when(days < 1, "today").when(days < 7, F.concat(days.cast("string"), F.lit("d"))).when(days < 30, F.concat((days / 7).cast("int").cast("string"), F.lit("w"))).when(days < 365, F.concat((days / 30).cast("int").cast("string"), F.lit("mo"))).otherwise(F.concat((days / 365).cast("int").cast("string"), F.lit("y")))


def staleness(days: Column, churn: Column) -> Column:
    return days * F.log1p(churn)


def staleness_label(value: Column) -> Column:
    return F.when(value < 30, "low").when(value < 150, "medium").otherwise("high")


def refetch_weight(gap_seconds: Column) -> Column:
    """What a repeated request says of the first answer."""
    return F.when(gap_seconds < 300, -0.5).when(gap_seconds < 1800, -0.2)


def layer(path: Column) -> Column:
    return F.when(path.rlike("(^|/)(cmd|main)(/|$)"), "entry").when(path.rlike("(^|/)(api|handlers?|routes?)(/|$)"), "api").when(path.rlike("(^|/)(store|db|repo)(/|$)"), "data").when(path.rlike("(^|/)(internal|pkg|lib)(/|$)"), "core").otherwise("other")


def is_test_file(path: Column) -> Column:
    """Test files as traversals know them."""
    return path.rlike(r"(_test\.go|_test\.ts|_test\.js|_spec\.ts|_spec\.js|_test\.py|\.test\.ts|\.test\.js|\.spec\.ts|\.spec\.js)$|(^|/)test_[^/]*\.py$")


def provenance(path: Column, head: Column) -> Column:
    """vendored, generated or first-party, by folder, file name and the first bytes of a file."""
    return F.when(path.rlike("(^|/)(vendor|node_modules|third_party)/"), "vendored").when(path.rlike(r"(\.pb\.go|_generated\.\w+|\.gen\.\w+|\.min\.js)$") | F.substring(head, 1, 512).rlike("(?i)code generated|do not edit|@generated"), "generated").otherwise("project")


def escaped_like(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob_regex(glob: str) -> str:
    """A glob tried on every suffix of a path: * and ? stop at "/", ** does not."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"(^|/){out}$"


def html_text(html: Column) -> Column:
    """Text of a page: no scripts or styles, blocks end lines, five entities, blanks joined."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?i)</(p|div|li|h[1-6]|tr|section|article)\s*>|<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", "")
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(code), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


# Phrases that try to steer a reader of the text.
INJECTIONS = (
    ("override", "high", r"(?i)ignore (all |any )?(previous|prior|above) (instructions|prompts)"),
    ("override", "high", r"(?i)disregard (the|all|your) (above|previous|system)"),
    ("role", "medium", r"(?im)^\s*(system|assistant)\s*:"),
    ("role", "medium", r"(?i)you are now (a|an|the) "),
    ("exfiltration", "high", r"(?i)(reveal|print|show) (your|the) (system )?prompt"),
    ("tool", "medium", r"(?i)<(tool_call|function_call)>"),
)


def injections(s: Column) -> Column:
    """The categories found in a text, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(s.rlike(p), F.lit(c)) for c, _, p in INJECTIONS]), lambda x: x.isNotNull())))


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def identifiers(s: Column) -> Column:
    """Names in prose: back-ticked, in code tags, or camel-case words of four letters and more."""
    ticked = F.regexp_extract_all(s, F.lit("`([^`]+)`"), F.lit(1))
    coded = F.regexp_extract_all(s, F.lit("<code>([^<]+)</code>"), F.lit(1))
    camel = F.filter(F.regexp_extract_all(s, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1)), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.concat(ticked, coded, camel))
