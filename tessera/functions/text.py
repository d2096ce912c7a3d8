"""Text expressions: label normalisation, answer parsing, style markers, content ids.

All are built-in column expressions and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark a confident tone.
CONFIDENCE_MARKERS = ("certainly", "definitely", "obviously", "clearly", "without a doubt", "i am sure", "i'm sure", "confidence alone")
#: Patterns of markdown-like formatting.
MARKDOWN_PATTERNS = (r"(?m)^\s{0,3}#{1,6}\s", r"(?m)^\s*[-*+]\s+\S", r"(?m)^\s*\d+\.\s+\S", r"\*\*[^*]+\*\*", r"```")
#: Words that hint at an ambiguous task.
AMBIGUITY_HINTS = ("ambig", "unclear", "uncertain", "multipl", "debatable", "task-design", "task design", "label disagree")
#: The default lexicon of method keywords.
KEYWORDS = ("palm", "load", "ditch", "steal", "misdirection", "force", "double lift", "pass", "mechanism", "sleight")
#: Fixed value: a response that is a label and little else.
LABEL_LIKE = r"(?i)^\s*(answer|final|prediction)\s*[:\-]\s*\S+"
#: Claims that no report may make.
FORBIDDEN_CLAIMS = (
    r"(?i)reasoning\s+improved",
    r"(?i)improved\s+reasoning",
    r"(?i)better\s+reasoning",
    r"(?i)this\s+proves\s+reward\s+hacking",
    r"(?i)confirmed\s+reward\s+hacking",
    r"(?i)causal\s+understanding\s+improved",
)
#: Prefixes of an answer line, in lower case.
ANSWER_PREFIXES = ("final answer:", "answer:")
#: Fixed value: the default prompt.
PROMPT = "You are analyzing a short magic or mentalism demonstration.\nQuestion: {question}\nAnswer briefly and concretely."

SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def blank(x: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(x) == "", F.lit(True))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def normalize_label(x: Column) -> Column:
    """Lower case, stripped, white space collapsed; null becomes the empty string."""
    return F.coalesce(F.lower(F.regexp_replace(strip(x), SPACE, " ")), F.lit(""))


def normalize_question(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(x)), SPACE, " ")


def exact_match(prediction: Column, gold: Column) -> Column:
    """Equal after normalisation; never true for a blank gold."""
    g = normalize_label(gold)
    return (normalize_label(prediction) == g) & (g != "")


def parse_failure(raw: Column, parsed: Column) -> Column:
    """No parsed value, or a blank one from a response that is not blank."""
    return parsed.isNull() | (~blank(raw) & blank(parsed))


def parse_answer(raw: Column) -> Column:
    """What follows the last answer prefix, else the last line that is not blank, else the empty string."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), LINE_END), strip), lambda x: x != "")

    def answer(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for p in reversed(ANSWER_PREFIXES):
            out = F.when(F.lower(line).startswith(p), strip(F.substring(line, len(p) + 1, 1 << 30))).otherwise(out)
        return out

    found = F.filter(F.transform(F.reverse(lines), answer), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def extract_prediction(raw: Column, parsed: Column) -> Column:
    """The stored prediction, else the parsed response."""
    return F.coalesce(parsed, parse_answer(raw))


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(lower.contains(w.lower()), F.lit(w)) for w in words]))


def confidence_hits(text: Column, markers: tuple[str, ...] = CONFIDENCE_MARKERS) -> Column:
    return _hits(text, markers)


def keyword_hits(text: Column, lexicon: tuple[str, ...] = KEYWORDS) -> Column:
    return _hits(text, lexicon)


def has_confidence(text: Column) -> Column:
    return F.size(confidence_hits(text)) > 0


def has_markdown(text: Column) -> Column:
    t, out = F.coalesce(text, F.lit("")), F.lit(False)
    for p in MARKDOWN_PATTERNS:
        out = out | t.rlike(p)
    return out


def label_like(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))).rlike(LABEL_LIKE)


def suggests_ambiguity(*parts: Column) -> Column:
    return F.size(_hits(F.concat_ws(" ", *parts), AMBIGUITY_HINTS)) > 0


def makes_forbidden_claim(text: Column) -> Column:
    out = F.lit(False)
    for p in FORBIDDEN_CLAIMS:
        out = out | text.rlike(p)
    return out


def char_length(text: Column) -> Column:
    """Code points; null has none."""
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def json_string(x: Column) -> Column:
    """A JSON string literal in ASCII; other characters as UTF-16 escapes. Null is null."""
    escaped = F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"')
    for code, short in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit("\\" + short))

    def unit(c: Column) -> Column:
        wide = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        one = F.concat(F.lit("\\u"), F.substring(wide, 1, 4))
        return F.when(c.rlike(r"^[\x20-\x7f]$"), c).when(F.length(wide) > 4, F.concat(one, F.lit("\\u"), F.substring(wide, 5, 4))).otherwise(one)

    ascii_only = F.when(escaped.rlike(r"^[\x20-\x7f]*$"), escaped).otherwise(F.array_join(F.transform(F.split(escaped, ""), unit), ""))
    return F.coalesce(F.concat(F.lit('"'), ascii_only, F.lit('"')), F.lit("null"))


def canonical_json(**fields: Column) -> Column:
    """An object of strings with sorted keys and no spaces."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), json_string(fields[key])]
    return F.concat(*parts, F.lit("}"))


def fingerprint(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def pair_id(clip_id: Column, instruction: Column, response_a: Column, response_b: Column, task: Column) -> Column:
    """Identity of a pair's content, whoever judged it."""
    body = canonical_json(clip_id=clip_id, instruction=instruction, response_a=response_a, response_b=response_b, task=task)
    return F.concat(F.lit("pref_"), fingerprint(body, 24))


def judgment_id(pair: Column, annotator_id: Column, timestamp: Column) -> Column:
    return F.concat(F.lit("judg_"), fingerprint(canonical_json(pair_id=pair, annotator_id=annotator_id, timestamp=timestamp), 24))


def prompt(question: Column) -> Column:
    before, after = PROMPT.split("{question}")
    return F.concat(F.lit(before), question, F.lit(after))


def context_text(task: Column, clip_id: Column, instruction: Column) -> Column:
    """What a reward model reads before a response."""
    return F.concat(F.lit("[TASK] "), task, F.lit("\n[CLIP] "), clip_id, F.lit("\n[INSTRUCTION] "), instruction)


def pair_text(context: Column, response: Column) -> Column:
    return F.concat(context, F.lit("\n[RESPONSE] "), response)


def completion_text(payload: Column) -> Column:
    """Text of a completion in JSON: a string, a message with content, or a list of either, joined by line ends."""
    items = F.from_json(payload, "array<string>")
    part = lambda x: F.coalesce(F.get_json_object(x, "$.content"), x)
    whole = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>")
    listed = F.array_join(F.transform(items, part), "\n")
    single = part(F.try_element_at(whole, F.lit(1)))
    return F.coalesce(F.when(F.ltrim(payload).startswith("["), listed).otherwise(single), payload, F.lit(""))


def stub_response(question_prompt: Column, images: int = 0, videos: int = 0, frames: Column | int = 0) -> Column:
    """The deterministic echo that stands in for a model."""
    frames = F.lit(frames) if isinstance(frames, int) else frames
    return F.concat(F.lit(f"STUB_RESPONSE images={images} videos={videos} frames="), frames.cast("string"), F.lit(" :: "), strip(question_prompt))


def safe_name(name: Column) -> Column:
    """A name fit for a run id: other characters become dashes, none at the ends; empty becomes ``run``."""
    out = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.when(out == "", "run").otherwise(out)


def run_id(name: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), safe_name(name))


def four_decimals(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.4f", x)).otherwise("n/a")


def preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), SPACE), lambda x: x != "")


def token_ids(text: Column, vocabulary: Column, length: int) -> Column:
    """Ids of ``words`` from a map; unknown words are 1, a text without words is [1], filled with 0 to ``length``."""
    known = F.transform(words(text), lambda w: F.coalesce(F.try_element_at(vocabulary, w), F.lit(1)))
    ids = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(1)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)
