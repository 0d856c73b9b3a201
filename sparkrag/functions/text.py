"""Text functions, all as Column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TEXT_CHARS = 50
CHARS_PER_TOKEN = 4
ELLIPSIS = " […]"

#: Words that carry no search meaning.
STOPWORDS = (
    "and are about did does for from how into that the their there this was were what when where which who whom why with"
).split()


def non_space_length(text: Column) -> Column:
    """Number of characters that are no Unicode white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s", "")), F.lit(0))


def has_text(text: Column, least: int = MIN_TEXT_CHARS) -> Column:
    return non_space_length(text) >= least


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def derive_doc_id(relative_path: Column, digest: Column) -> Column:
    """16 hex digits that name a version of a file."""
    return F.substring(F.sha2(F.concat(relative_path, F.lit(":"), digest), 256), 1, 16)


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    return F.concat_ws("::", doc_id, chunk_index.cast("string"))


def contextualized(context: Column, content: Column) -> Column:
    """The context, a blank line and the content; the content alone where there is no context."""
    return F.when(F.coalesce(context, F.lit("")) == "", content).otherwise(F.concat(context, F.lit("\n\n"), content))


def count_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def truncate_to_tokens(text: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("a number of tokens is not negative")
    return F.substring(text, 1, CHARS_PER_TOKEN * n)


def repair_newlines(text: Column) -> Column:
    """Line ends as \\n, and words hyphenated over a line end (or over blanks) made whole."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    joined = F.regexp_replace(unix, r"(?U)(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")
    return F.regexp_replace(joined, r"(?U)(\w)-[ \t]+(\w)", "$1$2")


def strip_markdown(text: Column) -> Column:
    """Prose without markdown's decoration, on one line: comments, rules and table borders vanish, headings and list
    items lose their marker, cells lose their bars, words their emphasis and escaped marks their backslash."""
    lines = F.split(F.regexp_replace(text, r"<!--[\s\S]*?-->", " "), r"\R")
    decorated = F.filter(lines, lambda line: ~line.rlike(r"^[\s|:-]+$"))
    marker = r"^\s*(?:#{1,6}\s+|[-+*]\s+|\d{1,3}[.)]\s+)"
    bare = F.transform(decorated, lambda line: F.regexp_replace(line, marker, ""))
    flat = F.array_join(bare, " ")
    # An escaped mark is hidden from the rules below as a character of the private area, and shown again at the end. A
    # text's own characters of that kind become two others meanwhile: a guard, and one that tells which.
    marks = "\\`*_{}[]()#+-.!|<>~"
    hidden = "".join(chr(0xE000 + i) for i in range(len(marks)))
    guard = chr(0xE000 + len(marks))
    own = {c: guard + chr(0xE100 + i) for i, c in enumerate(guard + hidden)}

    def shown(text: Column) -> Column:
        for mark, stand_in in zip(marks, hidden, strict=True):
            text = F.replace(text, F.lit("\\" + mark), F.lit(stand_in))
        plain = F.regexp_replace(text, r"\*+|\b_+|_+\b|(?<=\s)_+|_+(?=\s)", "")
        return F.translate(F.regexp_replace(plain, r"\||\.{3,}", " "), hidden, marks)

    guarded, back = flat, lambda text: text
    for c, two in own.items():
        guarded = F.replace(guarded, F.lit(c), F.lit(two))
        back = lambda text, inner=back, c=c, two=two: inner(F.replace(text, F.lit(two), F.lit(c)))
    out = F.when(flat.rlike(f"[{hidden[0]}-{guard}]"), back(shown(guarded))).otherwise(shown(flat))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"))


def snippets(text: Column, size: int = 8, step: int = 4) -> Column:
    """Sentences of up to size words whole, longer ones as windows of size words every step words and a last one."""
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), words)

    def windows(w: Column) -> Column:
        last = F.size(w) - size
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(F.greatest(last, F.lit(0)))))
        return F.when(F.size(w) <= size, F.array(F.array_join(w, " "))).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " ")))

    return F.array_distinct(F.flatten(F.transform(F.filter(sentences, lambda w: F.size(w) > 0), windows)))


def query_terms(text: Column, least: int = 3) -> Column:
    """Distinct lower-case letter-digit terms without stopwords, longest first, then by the term."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)
    kept = F.array_except(F.array_distinct(parts), F.lit(STOPWORDS))
    return F.transform(F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def highlight(text: Column, terms: list[str], opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Every place where a term begins a word, marked, whatever its case; longer terms first."""
    own = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not own:
        return text
    quoted = "|".join(r"\Q" + t.replace(r"\E", "") + r"\E" for t in own)
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({quoted})", f"{opening}$1{closing}")


def normalize_ocr(text: Column) -> Column:
    """Lower case, without ASCII marks, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def clean_response(text: Column) -> Column:
    """An answer without its reasoning: balanced blocks, an unclosed tail, and what stands before a lone closing tag."""
    balanced = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    tail = F.regexp_replace(balanced, r"(?s)<think>.*$", "")
    return F.regexp_replace(F.regexp_replace(tail, r"(?s)^.*</think>", ""), r"(?U)^\s+|\s+$", "")


def strip_label(text: Column, label: str) -> Column:
    """text without a leading echo of label, whatever its case."""
    return F.regexp_replace(F.trim(text), rf"(?i)^\Q{label}\E\s*", "")


def rewrite_or_raw(rewrite: Column, raw: Column, most: int = 512) -> Column:
    """The rewrite, unless it is missing, blank or longer than most characters."""
    own = F.trim(rewrite)
    return F.when(own.isNull() | (own == "") | (F.length(own) > most), raw).otherwise(own)


def format_query(text: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text)


def source_block(source: Column, context: Column, content: Column) -> Column:
    return F.concat(F.lit("[SOURCE]: "), source, F.lit("\n[CONTEXT]: "), F.coalesce(context, F.lit("")), F.lit("\n[CONTENT]: "), content)


def format_history(history: Column) -> Column:
    """A line "role: content" for each turn of an array, in order; empty without turns."""
    return F.coalesce(F.array_join(F.transform(history, lambda h: F.concat_ws(": ", h["role"], h["content"])), "\n"), F.lit(""))


def filled(template: str, **columns: Column) -> Column:
    """The template with each {name} replaced by the column of that name, once; nulls leave nothing. Braces in what the
    columns hold are plain text; doubled braces of the template are single ones."""
    parts = []
    for before, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(before))
        if name is not None:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def truncate_with_ellipsis(text: Column, most: int) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, max(most - len(ELLIPSIS), 0)), r"(?U)\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def title(text: Column, most: int = 80, default: str = "New conversation") -> Column:
    """One line without outer quotes, cut to most characters; default where nothing is left."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    bare = F.trim(F.regexp_replace(flat, r"""^["'“”]+|["'“”]+$""", ""))
    return F.when(bare == "", F.lit(default)).otherwise(F.rtrim(F.substring(bare, 1, most)))


def generation_budget(prompt_tokens: Column, context: int, headroom: int, floor: int, ceiling: int) -> Column:
    """Tokens left for an answer: within floor and ceiling."""
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.lit(context - headroom) - prompt_tokens))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def relative_path(url: Column) -> Column:
    """A URL's path, without host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")


def split_list(text: Column, separator: str = "<SEP>", unknown: str = "unknown_source") -> Column:
    """Trimmed parts in order of first appearance, without empty and unknown ones."""
    parts = F.transform(F.split(text, rf"\Q{separator}\E"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != unknown)))


def doc_key(thread_id: Column, first: Column, last: Column) -> Column:
    """The key of a transcript of the days first to last of a thread: thread::day, or thread::day..day."""
    return F.concat_ws("::", thread_id, span(first, last))


def span(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("..", first.cast("string"), last.cast("string")))


def key_parts(key: Column) -> Column:
    """thread_id and span of a transcript key; the span is null where there is none."""
    at = F.length(key) - F.length(F.substring_index(key, "::", -1)) - 2
    return F.struct(F.when(at >= 0, F.substr(key, F.lit(1), at)).otherwise(key).alias("thread_id"), F.when(at >= 0, F.substring_index(key, "::", -1)).alias("span"))


def transcript_label(name: Column, days: Column) -> Column:
    """name (span), or the name alone."""
    return F.when(F.coalesce(days, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ("), days, F.lit(")")))


def thread_header(text: Column) -> Column:
    """The thread name in a transcript's first heading; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?m)^# (.+?) \([0-9.-]+\)$", 1), F.lit(""))


def apple_timestamp(value: Column) -> Column:
    """Seconds or, beyond 10**12, nanoseconds since 2001-01-01 UTC; null and 0 are that day."""
    v = F.coalesce(value, F.lit(0))
    micros = F.when(v > 10**12, F.expr("bigint(0)") + F.floor(v / 1000)).otherwise(v * 1_000_000)
    return F.timestamp_micros((micros + 978_307_200_000_000).cast("long"))


#: Reaction codes; 3000 and up take back what 2000 and up add.
REACTIONS = ["loved", "liked", "disliked", "laughed", "emphasized", "questioned"]


def reaction_kind(code: Column) -> Column:
    kind = F.get(F.lit(REACTIONS), (code % 1000).cast("int"))
    return F.when(((code >= 2000) & (code <= 2005)) | ((code >= 3000) & (code <= 3005)), kind)


def reaction_sign(code: Column) -> Column:
    return F.when((code >= 2000) & (code <= 2005), 1).when((code >= 3000) & (code <= 3005), -1)


def reaction_target(guid: Column) -> Column:
    """A target's guid without its part prefix (p:N/ or bp:)."""
    return F.regexp_replace(guid, r"^(?:p:\d+/|bp:)", "")


def entity_type(kind: Column) -> Column:
    own = F.lower(F.trim(kind))
    return F.when(F.coalesce(own, F.lit("")) == "", F.lit("untyped")).otherwise(own)


def node_size(degree: Column, most: Column, least: float = 4.0, largest: float = 18.0) -> Column:
    """Between least and largest, growing with the square root of the degree's share of the highest one."""
    return F.when(most <= 0, F.lit(least)).otherwise(F.lit(least) + F.lit(largest - least) * F.sqrt(F.greatest(degree, F.lit(0)) / most))
