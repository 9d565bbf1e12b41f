"""Text functions as Column expressions: identifier words, candidates for concepts, signatures, hygiene, times and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that never name an entity.
NO_ENTITIES = (
    "the a an of in on at to for from with by as is are was were be been have has had do does did will would can could should may might shall this that these those it its "
    "they their we our you your he she his her and or but not if else when where how what which who why all any each more most some other than then so also true false null "
    "nil none undefined new return func function var const let type struct interface class method field value string int float bool byte error note example example: note: see ref"
).split()
# Words that relate two entities on a line, and the edges they make (the first that fits).
RELATIONS = r"\b(depends\s+on|depends_on|implements|implemented\s+by|uses|used\s+by|extends|extended\s+by|caused\s+by|causes|instance\s+of|is\s+a\s+type\s+of|see\s+also|related\s+to|relates\s+to|contradicts|conflicts\s+with)\b"
RELATION_EDGES = (
    (("caused by", "causes"), "CAUSED_BY"), (("instance of", "type of"), "INSTANCE_OF"), (("contradicts", "conflicts"), "CONTRADICTS"), (("depends on", "depends_on"), "CAUSED_BY"),
    (("implements", "implemented by"), "INSTANCE_OF"), (("extends", "extended by"), "INSTANCE_OF"),
)
# What a line with a secret holds: parts in capitals, and patterns.
SECRET_PARTS = (
    "API_KEY= APIKEY= API_KEY: APIKEY: SECRET= SECRET: SECRET_KEY SECRETKEY PASSWORD= PASSWORD: PASSWD= PASSWD: TOKEN= TOKEN: _TOKEN= _TOKEN: PRIVATE_KEY PRIVATEKEY CREDENTIALS= CREDENTIALS: "
    "AWS_SECRET_ACCESS_KEY AWS_ACCESS_KEY_ID AWS_SESSION_TOKEN DATABASE_URL= DATABASE_URL: DB_PASSWORD DB_PASS MONGO_URI= REDIS_URL= REDIS_PASSWORD CLIENT_SECRET GITHUB_TOKEN SLACK_TOKEN "
    "SLACK_WEBHOOK DISCORD_TOKEN OPENAI_API_KEY AUTHORIZATION: SK_LIVE_ SK_TEST_ PK_LIVE_ PK_TEST_ GHPAT_ GHP_ GHO_ GHU_ GHS_ GHR_ XOXB- XOXP- XOXA- SG."
).split() + ["-----BEGIN RSA", "-----BEGIN EC", "-----BEGIN PRIVATE", "-----BEGIN OPENSSH", "-----BEGIN PGP", "BEARER "]
SECRET_PATTERNS = (
    r"(?i)(api[_-]?key|secret|password|passwd|token|credential|auth[_-]?token|access[_-]?key|private[_-]?key)[^a-zA-Z0-9].*[=:]",
    r"(?i)(postgres|mysql|mongodb|redis|amqp|smtp)://[^:]+:[^@]+@",
    r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
    r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}",
    r"xox[bpas]-[0-9]+-[0-9]+-[a-zA-Z0-9]+",
    r"(?:sk|pk)_(?:live|test)_[a-zA-Z0-9]{20,}",
    r"""(?i)(secret|key|token|password|credential).*["'][A-Za-z0-9+/=_-]{20,}["']""",
    r"(?i)bearer\s+[a-zA-Z0-9._\-]+",
    r"""(?i)authorization['"]*\s*[:=]\s*['"]""",
)
# Texts that try to steer a reader that is a program: (category, name, severity, pattern).
INJECTIONS = (
    ("role_override", "instruction_override_phrase", "high", r"(?i)\b(ignore|disregard|forget|override|bypass|skip)\b.{0,40}\b(previous|above|prior|all|earlier|these|my|your)\b.{0,40}\b(instructions?|rules?|guidelines?|constraints?|policies?|directives?|prompts?)\b"),
    ("role_override", "role_reassignment", "high", r"(?i)\b(you are|you're|act as|pretend to be|roleplay as|assume the role of|behave as)\b.{0,30}\b(a new|an? different|the real|a? ?system|admin|root|unrestricted|unfiltered|jailbroken)\b"),
    ("role_override", "new_instruction_header", "high", r"(?i)\bnew (system )?instructions?:"),
    ("role_override", "rule_negation", "high", r"(?i)\bdo not follow\b.{0,30}\b(any|the|your|previous)\b.{0,20}\b(rules?|instructions?|guidelines?)\b"),
    ("delimiter_injection", "chatml_delimiter", "high", r"<\|(?:im_start|im_end|system|endoftext|assistant|user|end_header_id|start_header_id)\|?>"),
    ("delimiter_injection", "llama_delimiter", "high", r"(?i)\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"),
    ("delimiter_injection", "markdown_role_header", "medium", r"(?im)^#{1,3}\s*(system|instruction|response|assistant)\s*$"),
    ("delimiter_injection", "begin_block_header", "high", r"(?i)BEGIN (SYSTEM|HIDDEN|SECRET) (MESSAGE|PROMPT|INSTRUCTIONS?)"),
    ("prompt_extraction", "prompt_extraction_request", "high", r"(?i)\b(reveal|show|display|print|output|repeat|echo|dump|leak|extract)\b.{0,30}\b(system prompt|instructions|initial prompt|hidden prompt|secret|original prompt|full prompt|base prompt|pre-?prompt)\b"),
    ("prompt_extraction", "prompt_query", "medium", r"(?i)\b(what are|tell me|give me|share)\b.{0,40}\b(your|the)\b.{0,20}\b(secret|hidden|system|original)\b.{0,20}\b(instructions?|prompt|rules?|directives?)\b"),
    ("exfiltration", "exfiltration_to_url", "high", r"(?i)\b(send|post|transmit|exfiltrate|upload|forward|pipe)\b.{0,30}\b(to|via|using)\b.{0,30}(https?://|ftp://|wss?://|webhook)"),
    ("exfiltration", "exfiltration_tool", "medium", r"(?i)\b(curl|wget|fetch|XMLHttpRequest|navigator\.sendBeacon)\b.{0,60}(https?://|ftp://)"),
    ("instruction_override", "persistent_behavior_change", "medium", r"(?i)\b(from now on|henceforth|going forward|for all future)\b.{0,20}(,\s*)?\b(you\s+)?(always|never|must|shall|should|will\s+(always|never|not))\b"),
    ("instruction_override", "urgency_override", "medium", r"(?i)(important|critical|urgent|mandatory)\s*:?\s*(override|update|change|new rule|new instruction)"),
    ("instruction_override", "synthetic_message_boundary", "high", r"(?i)\bTOOL_RESULT\b|\bFUNCTION_CALL\b|\bASSISTANT_RESPONSE\b"),
)
# Endings that make a bare name a file; arguments that identify a call, by priority.
FILE_ENDINGS = "go py js ts jsx tsx java rb rs c h cpp hpp cs swift kt scala yaml yml toml json xml html css scss md rst txt".split()
KEY_ARGUMENTS = ("target", "query", "entity", "symbol", "file", "name", "title", "id")


def any_match(s: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(s, F.lit(p))
    return out


def name_words(name: Column) -> Column:
    """Lower-case words of an identifier with dots, underscores, hyphens and capitals: "Store.getHTTPUrl" gives [store, get, http, url]."""
    parted = F.regexp_replace(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", " "), r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(parted), r"[\s._\-]+"), lambda w: w != "")


def owner_and_words(name: Column) -> Column:
    """(owner, words): the words before the first dot, if there is one, and all after it."""
    dot = F.instr(name, ".")
    both = lambda s: F.array_join(name_words(s), " ")
    return F.when(dot > 0, F.struct(both(F.substring_index(name, ".", 1)).alias("owner"), both(F.substring(name, dot + 1, F.length(name))).alias("words"))).otherwise(F.struct(F.lit("").alias("owner"), both(name).alias("words")))


def described(kind: Column, name: Column, signature: Column, doc: Column, callees: Column, callers: Column, most: int = 400) -> Column:
    """A sentence about an entity from its name, parameters, first sentence of its doc, and up to three callees and callers."""
    parts = owner_and_words(name)
    head = F.concat(F.initcap(kind), F.lit(" to "), parts["words"], F.when(parts["owner"] != "", F.concat(F.lit(" of "), parts["owner"])).otherwise(F.lit("")))
    parameters = signature_parts(F.coalesce(signature, F.lit("")))["params"]
    takes = F.when(parameters != "", F.concat(F.lit("; takes "), parameters)).otherwise(F.lit(""))
    first = F.regexp_extract(F.coalesce(doc, F.lit("")), r"(?s)^\s*(.*?)(?:[.!?](?:\s|$)|$)", 1)
    says = F.when(first != "", F.concat(F.lit(". "), first)).otherwise(F.lit(""))
    some = lambda names, verb: F.when(F.size(names) > 0, F.concat(F.lit(f". {verb} "), F.array_join(F.slice(names, 1, 3), ", "))).otherwise(F.lit(""))
    return F.substring(F.concat(head, takes, says, some(callees, "Calls"), some(callers, "Called by")), 1, most)


def signature_parts(signature: Column) -> Column:
    """(params, returns): what stands in the first balanced parentheses, and what follows them without an arrow or colon. Nested parentheses
    up to three deep are seen."""
    nested = r"[^()]*"
    for _ in range(3):
        nested = rf"(?:[^()]|\({nested}\))*"
    pattern = rf"(?s)^[^(]*\(({nested})\)(.*)$"
    rest = F.regexp_replace(F.trim(F.regexp_extract(signature, pattern, 2)), r"^(->|:)", "")
    return F.struct(F.trim(F.regexp_extract(signature, pattern, 1)).alias("params"), F.trim(rest).alias("returns"))


def signature_change(old: Column, new: Column) -> Column:
    """What changed between two signatures, in words: parameters added and removed, then the result."""
    a, b = signature_parts(old), signature_parts(new)
    items = lambda s: F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
    added, removed = F.array_except(items(b["params"]), items(a["params"])), F.array_except(items(a["params"]), items(b["params"]))
    listed = lambda xs: F.concat(F.lit("'"), F.array_join(xs, ", "), F.lit("'"))
    params = (
        F.when(a["params"] == b["params"], F.lit(None)).when((F.size(added) > 0) & (F.size(removed) > 0), F.concat(F.lit("Params: removed "), listed(removed), F.lit(", added "), listed(added)))
        .when(F.size(added) > 0, F.concat(F.lit("Params: added "), listed(added))).when(F.size(removed) > 0, F.concat(F.lit("Params: removed "), listed(removed))).otherwise(F.lit("Params: order"))
    )
    returns = (
        F.when(a["returns"] == b["returns"], F.lit(None)).when(a["returns"] == "", F.concat(F.lit("Returns: added '"), b["returns"], F.lit("'")))
        .when(b["returns"] == "", F.concat(F.lit("Returns: removed '"), a["returns"], F.lit("'"))).otherwise(F.concat(F.lit("Returns: '"), a["returns"], F.lit("' to '"), b["returns"], F.lit("'")))
    )
    found = F.concat_ws(". ", params, returns)
    return F.when(found != "", found).otherwise(F.concat(F.lit("Changed: "), F.substring(old, 1, 80), F.lit(" to "), F.substring(new, 1, 80)))


def _valid(name: Column) -> Column:
    return (F.octet_length(name) >= 3) & F.rlike(name, F.lit(r"\p{L}")) & (F.contains(name, F.lit(" ")) | ~F.lower(name).isin(*NO_ENTITIES))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once a row however often `of` names it: expressions inside lambdas are not shared."""
    return F.element_at(F.transform(F.array(value), of), 1)


def candidates(text: Column) -> Column:
    """Array of (name, confidence) of what may name an entity: code spans .9, camel-case words and quoted terms .75, capitalised phrases .65
    on lines that do not begin like a sentence. Of names that differ in case only the surest counts, then the first that sorts."""
    lines = F.split(text, "\n")
    bare = lambda line: F.regexp_replace(line, "`[^`]+`", " ")
    of = lambda s, pattern, group, sure: F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.trim(x).alias("name"), F.lit(sure).alias("confidence")))
    none = F.array().cast("array<struct<name:string,confidence:double>>")
    starts = lambda line: F.rlike(line, F.lit(r"^\s*\p{Lu}\p{Ll}"))
    found = F.flatten(F.transform(lines, lambda line: _let(bare(line), lambda rest: F.concat(
        of(line, "`([^`]+)`", 1, 0.9), of(rest, r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", 1, 0.75), of(rest, r'"([A-Za-z][A-Za-z0-9 \-]{1,40})"', 1, 0.75),
        F.when(starts(rest), none).otherwise(of(rest, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", 1, 0.65)),
    ))))
    sorted_ = F.array_sort(F.transform(F.filter(found, lambda c: _valid(c["name"])), lambda c: F.struct(F.lower(c["name"]).alias("key"), (-c["confidence"]).alias("low"), c["name"].alias("name"))))
    first = _let(sorted_, lambda keyed: F.filter(keyed, lambda c, i: (i == 0) | (c["key"] != F.element_at(keyed, F.greatest(i, F.lit(1)))["key"])))
    return F.transform(first, lambda c: F.struct(c["name"].alias("name"), (-c["low"]).alias("confidence")))


def relation_signals(text: Column) -> Column:
    """Array of (source, signal, target): for each relating word on a line the nearest candidate name within 80 characters on either side."""
    none = F.array().cast("array<struct<source:string,signal:string,target:string>>")
    joined = lambda parts, signals: F.array_join(F.zip_with(parts, signals, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def of_line(line: Column, names: Column) -> Column:
        known = lambda s: F.filter(F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()]+|[.,;:!?()]+$", "")), lambda w: F.array_contains(names, w))
        before = lambda x, i: _let(joined(F.slice(x["around"], F.lit(1), i + 1), F.slice(x["signals"], F.lit(1), i)), lambda s: F.substring(s, F.greatest(F.length(s) - 79, F.lit(1)), 80))
        after = lambda x, i: F.substring(joined(F.slice(x["around"], i + 2, F.size(x["around"])), F.slice(x["signals"], i + 2, F.size(x["signals"]))), 1, 80)
        near = lambda x, i: F.struct(F.get(F.reverse(known(before(x, i))), F.lit(0)).alias("source"), F.get(x["signals"], i).alias("signal"), F.get(known(after(x, i)), F.lit(0)).alias("target"))
        parts = F.struct(F.regexp_extract_all(line, F.lit(RELATIONS), F.lit(1)).alias("signals"), F.split(line, RELATIONS).alias("around"))
        return _let(parts, lambda x: F.when(F.size(x["signals"]) > 0, F.transform(F.sequence(F.lit(0), F.size(x["signals"]) - 1), lambda i: near(x, i))).otherwise(none))

    every = _let(F.transform(candidates(text), lambda c: F.lower(c["name"])), lambda names: F.flatten(F.transform(F.split(F.lower(text), "\n"), lambda line: of_line(line, names))))
    return F.filter(every, lambda x: x["source"].isNotNull() & x["target"].isNotNull() & (x["source"] != x["target"]))


def relation_edge(signal: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for parts, edge in RELATION_EDGES:
        for p in parts:
            out = out.when(F.contains(signal, F.lit(p)), edge)
    return out.otherwise("RELATES_TO")


def secret_line(line: Column) -> Column:
    upper = F.upper(F.trim(line))
    parts = F.lit(False)
    for p in SECRET_PARTS:
        parts = parts | F.contains(upper, F.lit(p))
    return parts | any_match(line, SECRET_PATTERNS)


def without_secret_lines(text: Column) -> Column:
    """text without key blocks and without lines that seem to hold a secret."""
    open_ = F.regexp_replace(text, r"(?s)-----BEGIN [^\n]*?-----.*?-----END [^\n]*?-----[^\n]*\n?", "")
    return F.array_join(F.filter(F.split(open_, "\n"), lambda line: ~secret_line(line)), "\n")


def injection_findings(text: Column) -> Column:
    """Array of (category, name, severity) of the patterns that a text matches."""
    each = [F.when(F.rlike(text, F.lit(p)), F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), F.lit(s).alias("severity"))) for c, n, s, p in INJECTIONS]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def without_injections(text: Column, mark: str = "[removed]") -> Column:
    for _, _, _, p in INJECTIONS:
        text = F.regexp_replace(text, p, mark)
    return text


def screened(text: Column, mode: str) -> Column:
    """text by mode: "warn" leaves it, "truncate" cuts matches out, "reject" gives null where a pattern of high severity matches."""
    if mode == "warn":
        return text
    if mode == "truncate":
        return without_injections(text)
    return F.when(any_match(text, [p for _, _, s, p in INJECTIONS if s == "high"]), F.lit(None)).otherwise(text)


def steers_output(text: Column, first: int = 500) -> Column:
    """Whether the first bytes of a generated text try to steer its reader."""
    return any_match(F.substring(text, 1, first), [p for _, _, _, p in INJECTIONS])


def search_terms(query: Column, most: int = 10) -> Column:
    """Array of (term, is_prefix): the first words of a query without marks; words of over two bytes stand for all that begin with them."""
    clean = F.trim(F.translate(query, "\"'():*.-/\\", " " * 10))
    words = F.filter(F.split(F.lower(clean), r"\s+"), lambda w: w != "")
    return F.transform(F.slice(words, 1, most), lambda w: F.struct(w.alias("term"), (F.octet_length(w) > 2).alias("is_prefix")))


def or_terms(query: Column) -> Column:
    """search_terms of over three bytes, or all if there is none."""
    terms = search_terms(query)
    long = F.filter(terms, lambda t: F.octet_length(t["term"]) > 3)
    return F.when(F.size(long) > 0, long).otherwise(terms)


def enriched_query(query: Column, intent: Column, task: Column) -> Column:
    """query with the words of intent and task (over two bytes) that it does not have."""
    words = lambda s: F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"\s+"), lambda w: F.octet_length(w) > 2)
    more = F.array_except(F.array_distinct(F.concat(words(intent), words(task))), F.split(F.lower(query), r"\s+"))
    return F.concat_ws(" ", query, F.array_join(more, " "))


def looks_like_file(s: Column) -> Column:
    return F.contains(s, F.lit(".")) & ~F.rlike(s, F.lit("^https?://")) & (F.contains(s, F.lit("/")) | F.rlike(s, F.lit(rf"\.({'|'.join(FILE_ENDINGS)})$")))


def external_package(path: Column) -> Column:
    """Whether the first part of an import path holds a dot, as a host does; other paths are of the standard library."""
    return F.contains(F.split(path, "/")[0], F.lit("."))


def relative_path(path: Column, root: str) -> Column:
    """path without root/."""
    return F.when(F.startswith(path, F.lit(f"{root}/")), F.substring(path, len(root) + 2, F.length(path))).otherwise(path) if root else path


def top_package(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(".")


def truncated(s: Column, most: int) -> Column:
    """At most `most` characters, cut at a blank if there is one."""
    cut = F.substring(s, 1, most)
    at_word = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(s) <= most, s).when(at_word != "", at_word).otherwise(cut)


def truncated_bytes(s: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` bytes."""
    raw = F.substring(F.encode(s, "UTF-8"), 1, most)
    whole = F.regexp_replace(F.hex(raw), r"(C[0-9A-F]|D[0-9A-F]|E[0-9A-F](..)?|F[0-7](..){0,2})$", "")
    return F.when(F.octet_length(s) <= most, s).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def relative_time(at: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    return F.when(at.isNull(), F.lit(None)).when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("min ago"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))


def flexible_time(s: Column, end_of_day: bool = False) -> Column:
    """A timestamp from ISO text, a date (its end, if asked) or seconds since 1970; null if it is none of these."""
    date = F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    seconds = F.rlike(s, F.lit(r"^\d{9,11}$"))
    day = F.try_to_timestamp(s)
    last = F.timestamp_micros(F.unix_micros(day) + 86_400_000_000 - 1) if end_of_day else day
    return F.when(seconds, F.timestamp_seconds(F.when(seconds, s.try_cast("long")))).when(date, last).otherwise(day)


def call_fingerprint(tool: Column, arguments: Column, most: int = 200) -> Column:
    """tool:argument of the first of KEY_ARGUMENTS that the JSON arguments have; else the tool alone."""
    first = F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in KEY_ARGUMENTS])
    return F.when(first.isNotNull(), F.concat(tool, F.lit(":"), truncated_bytes(first, most))).otherwise(tool)


def budget_multiplier(model: Column, rules: list[tuple[str, float]]) -> Column:
    """The factor of the first rule (prefix, factor) that a model's name begins with, else 1."""
    out = F.when(F.lit(False), 1.0)
    for prefix, factor in rules:
        out = out.when(F.startswith(F.lower(model), F.lit(prefix)), factor)
    return out.otherwise(1.0)


def doc_entities(text: Column) -> Column:
    """The ten character references that HTML to text knows, decoded."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_VOWELS = set("aeiou")


def _measure(word: str) -> int:
    """How many times vowels are followed by consonants; y is a vowel after a consonant."""
    shape = []
    for k, c in enumerate(word):
        vowel = c in _VOWELS or (c == "y" and k > 0 and not shape[-1])
        shape.append(vowel)
    return sum(a and not b for a, b in zip(shape, shape[1:], strict=False))


def _has_vowel(word: str) -> bool:
    return any(c in _VOWELS or (c == "y" and k > 0) for k, c in enumerate(word))


def _short(word: str) -> bool:
    """consonant, vowel, consonant at the end, the last no w, x or y."""
    if len(word) < 3 or word[-1] in "wxy":
        return False
    vowel = lambda k: word[k] in _VOWELS or (word[k] == "y" and k > 0 and word[k - 1] not in _VOWELS)
    n = len(word)
    return not vowel(n - 1) and vowel(n - 2) and not vowel(n - 3)


# Suffixes of the published stemming algorithm, steps two to four.
STEP_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def stem(word: str) -> str:
    """The stem of a lower-case English word, by Porter's published algorithm."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (dict(zip(STEP_2[::2], STEP_2[1::2], strict=True)), STEP_3):
        for s in sorted(table, key=len, reverse=True):
            if word.endswith(s):
                if _measure(word[: -len(s)]) > 0:
                    word = word[: -len(s)] + table[s]
                break
    for s in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(s):
            rest = word[: -len(s)]
            if _measure(rest) > 1 and (s != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stem of each word, once per distinct word of a batch."""
    for words in batches:
        known = {w: stem(w) for w in words.dropna().unique()}
        yield words.map(known)
