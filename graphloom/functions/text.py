"""Scalar text, JSON and identifier expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The citation token, an 8-4-4-4-12 hexadecimal id in square brackets.
CITATION = r"\[([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\]"
#: Scheme of the URLs that name an image of a node in chat answers.
IMAGE_SCHEME = "kb"
SPACES = " \t\n\r\f\x0b"


def uuid_of(key: Column) -> Column:
    """A repeatable UUID-shaped id of a key."""
    return F.regexp_replace(F.md5(key), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def stripped(col: Column) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.btrim(col, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def query_words(query: Column) -> Column:
    """Words of a search box as typed: quotes dropped, empty ones left out."""
    return F.filter(F.transform(F.split(stripped(query), r"\s+"), lambda t: F.replace(t, F.lit('"'), F.lit(""))), lambda t: t != "")


def query_terms(query: Column) -> Column:
    """Words of a search box in lower case; each is a prefix and all are required."""
    return F.transform(query_words(query), F.lower)


def match_string(query: Column) -> Column:
    """The match expression of a search box: each word a quoted prefix, all of them required."""
    return F.array_join(F.transform(query_words(query), lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " ")


def extract_citations(text: Column) -> Column:
    """Cited ids in lower case, each once, in the order first seen."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda c: F.lower(c)))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[0-9a-fA-F-]{36}\]", "")


def first_pi_id(jsonld: Column, fallback: Column) -> Column:
    """Scope key of a record: from its metadata, else from the draft; broken metadata has none."""
    return F.coalesce(F.get_json_object(jsonld, "$.piId"), fallback)


def snippet(body: Column, chars: int = 200) -> Column:
    return F.substring(body, 1, chars)


def _inside(data: Column, at: Column) -> Column:
    """Whether the byte at ``at`` (from 0) continues a character."""
    return F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")


def _down(data: Column, at: Column) -> Column:
    """The nearest start of a character at or before ``at``; a character has four bytes at most."""
    return F.when(~_inside(data, at), at).when(~_inside(data, at - 1), at - 1).when(~_inside(data, at - 2), at - 2).otherwise(at - 3)


def _up(data: Column, at: Column) -> Column:
    return F.when(~_inside(data, at), at).when(~_inside(data, at + 1), at + 1).when(~_inside(data, at + 2), at + 2).otherwise(at + 3)


def cut_utf8(text: Column, limit: Column) -> Column:
    """At most ``limit`` bytes of a text, never a part of a character."""
    data = F.encode(text, "UTF-8")
    end = _down(data, F.least(limit, F.octet_length(text)))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "UTF-8"))


def embed_input(title: Column, body: Column, limit: int = 4096) -> Column:
    """Title, blank line and body, blank parts dropped; the body is cut so that all of it has at most ``limit`` bytes."""
    full = lambda c: F.coalesce(stripped(c) != "", F.lit(False))
    head = F.when(full(title), F.concat(title, F.lit("\n\n"))).otherwise("")
    room = F.greatest(F.lit(limit) - F.octet_length(head), F.lit(0))
    return F.concat(head, F.when(full(body), cut_utf8(body, room)).otherwise(""))


def body_window(body: Column, offset: int = 0, length: int | None = None, full: bool = False) -> Column:
    """``(body, truncated, offset, length, total)``: a window of a body in bytes, both ends moved inwards to characters.

    Without ``length`` the window has 8 KB. A body that fits from its start, or ``full``, is
    whole and not truncated.
    """
    limit = 8192 if length is None else length
    data, total = F.encode(body, "UTF-8"), F.octet_length(body)
    start = F.least(F.lit(offset), total)
    last = F.least(start + limit, total)
    end = F.greatest(_down(data, last), start)
    begin = F.least(_up(data, start), end)
    cut = F.lit(not full) & ((F.lit(offset) > 0) | (total > limit))
    piece = F.decode(F.substring(data, begin + 1, end - begin), "UTF-8")
    return F.when(
        body.isNotNull(),
        F.struct(
            F.when(cut, piece).otherwise(body).alias("body"), cut.alias("truncated"), F.when(cut, begin).otherwise(0).alias("offset"),
            F.when(cut, end - begin).otherwise(total).alias("length"), total.alias("total"),
        ),
    )


def data_url(col: Column) -> Column:
    """``(mime, payload)`` of a data URL, null for anything else or without a type."""
    pattern = r"(?s)^data:([^;,]+)[^,]*,(.*)$"
    mime = F.regexp_extract(col, pattern, 1)
    return F.when(mime != "", F.struct(mime.alias("mime"), F.regexp_extract(col, pattern, 2).alias("payload")))


def cache_key(payload: Column, supplier: Column, model: Column) -> Column:
    """Content key: digest, supplier and model, with characters that file names forbid replaced."""
    safe = lambda c: F.regexp_replace(c, r'[/\\:*?"<>|]', "_")
    return F.concat_ws("__", F.sha2(payload, 256), safe(supplier), safe(model))


#: First characters of a base64 payload by image type.
IMAGE_HEADS = {"image/png": ("iVBOR",), "image/jpeg": ("/9j/",), "image/gif": ("R0lGO",), "image/webp": ("UklGR",), "image/svg+xml": ("PHN2Z", "PD94b")}


def repair_mime(url: Column) -> Column:
    """A generic base64 data URL labelled by the first characters of its payload, as PNG where none is known."""
    head = "data:application/octet-stream;base64,"
    payload = F.substring(url, len(head) + 1, 1 << 30)
    kind = F.lit("image/png")
    for mime, heads in IMAGE_HEADS.items():
        for h in heads:
            kind = F.when(payload.startswith(h), mime).otherwise(kind)
    return F.when(url.startswith(head), F.concat(F.lit("data:"), kind, F.lit(";base64,"), payload)).otherwise(url)


def looks_binary(content: Column, limit: int = 4096, share: float = 0.3) -> Column:
    """A NUL, or more than ``share`` bytes outside tab, line ends and printable ASCII, in the first ``limit`` bytes of a binary column."""
    # one character for each byte
    head = F.decode(F.substring(content, 1, limit), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, r"[\t\n\r\x20-\x7E]", ""))
    return F.contains(head, F.lit("\x00")) | (odd > F.length(head) * share)


#: Alternative texts that office programs make up.
BOILERPLATE = (
    r"(?i)^(A|An) (screenshot|picture|photo|image|diagram|drawing|graphic|chart|map|illustration|icon)\b",
    r"(?i)Description automatically generated\.?$",
    r"(?i)^AI[- ]generated content may be incorrect\.?$",
)


def clean_alt(alt: Column, number: Column) -> Column:
    """Alternative text, or ``image-<n>`` where it is machine boilerplate."""
    text = stripped(F.coalesce(alt, F.lit("")))
    plain = collapsed(text)
    machine = plain == ""
    for pattern in BOILERPLATE:
        machine = machine | plain.rlike(pattern)
    return F.when(machine, F.concat(F.lit("image-"), number.cast("string"))).otherwise(text)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, white space collapsed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: collapsed(p)), lambda p: p != "")


def pad_rows(rows: Column) -> Column:
    """Ragged rows filled with empty cells up to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


#: Headings of front matter, on trimmed lower-case text.
FRONT_MATTER = (
    r"^(table\s+of\s+)?contents$", r"^toc$", r"^index$", r"^glossary$", r"^acronyms?$", r"^abbreviations?$", r"^list\s+of\s+(figures|tables|abbreviations|acronyms)$",
    r"^cover(\s+page)?$", r"^title(\s+page)?$", r"^copyright$", r"^revision\s+history$", r"^document\s+(history|control|information)$", r"^acknowledg(e)?ments?$",
    r"^preface$", r"^foreword$", r"^bibliography$", r"^references$",
)


def is_front_matter(heading: Column) -> Column:
    return F.lower(stripped(heading)).rlike("|".join(f"(?:{p})" for p in FRONT_MATTER))


def claim_before(text: Column, position: Column) -> Column:
    """What a citation at ``position`` (from 1) supports: the last sentence before it, 80 characters at most."""
    start = F.greatest(F.lit(1), position - 240)
    before = F.substring(text, start, position - start)
    plain = collapsed(F.regexp_replace(before, CITATION, ""))
    # a sentence ends at . ! ? or ; and white space
    parts = F.split(F.regexp_replace(plain, r"([.!?;])\s+", "$1\n"), "\n")
    return F.right(F.trim(F.element_at(parts, -1)), F.lit(80))


def snippet_anchor(col: Column) -> Column:
    """A search snippet as plain text to look for: marks and ellipses dropped, 80 characters."""
    return F.substring(collapsed(F.regexp_replace(F.regexp_replace(col, "</?mark>", ""), "…", " ")), 1, 80)


def _image_pattern(scheme: str) -> str:
    return r"(?i)(?:!\[[^\]]*\]\()?" + scheme + r"://image/([0-9a-f-]{8,})/([^\s)\]]+)(?:\))?"


def _image_tokens(text: Column, scheme: str) -> Column:
    """``(key, raw)`` of every image token: node (in lower case) and image, and the token with its wrapper."""
    part = lambda k: F.regexp_extract_all(text, F.lit(_image_pattern(scheme)), F.lit(k))
    key = F.zip_with(part(1), part(2), lambda n, i: F.concat(F.lower(n), F.lit("/"), i))
    return F.zip_with(key, part(0), lambda k, r: F.struct(k.alias("key"), r.alias("raw")))


def image_refs(text: Column, scheme: str = IMAGE_SCHEME) -> Column:
    """``node/image`` of each image token, each once."""
    return F.array_distinct(F.transform(_image_tokens(text, scheme), lambda t: t["key"]))


def strip_image_refs(text: Column, scheme: str = IMAGE_SCHEME) -> Column:
    """A text without its image tokens, each as it is first written; three line ends or more become two."""
    seen = F.array().cast("array<struct<key:string,raw:string>>")
    first = F.aggregate(_image_tokens(text, scheme), seen, lambda acc, t: F.when(F.exists(acc, lambda s: s["key"] == t["key"]), acc).otherwise(F.array_append(acc, t)))
    bare = F.aggregate(F.transform(first, lambda t: t["raw"]), text, lambda acc, raw: F.replace(acc, raw, F.lit("")))
    return stripped(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def gate_body(body: Column, least: int = 200, most: int = 16000) -> Column:
    """A body worth summarising: null if short, cut with a notice if long."""
    return F.when(F.length(body) < least, F.lit(None).cast("string")).when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n\n[...truncated]"))).otherwise(body)


def parse_metadata(answer: Column) -> Column:
    """``(summary, keyPoints)`` of a model answer, null if it has neither."""
    plain = F.trim(F.regexp_replace(answer, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    got = F.from_json(F.when(plain.startswith("{"), plain), "summary string, keyPoints array<string>")
    summary = F.when(F.trim(got["summary"]) != "", F.trim(got["summary"]))
    points = F.slice(F.filter(F.transform(F.coalesce(got["keyPoints"], F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != ""), 1, 12)
    return F.when(summary.isNotNull() | (F.size(points) > 0), F.struct(summary.alias("summary"), points.alias("key_points")))


def section_context(title: Column, purpose: Column, style_hint: Column) -> Column:
    """Prompt lines on the section that is written in; the empty string where nothing is known of it."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    lines = F.concat_ws(
        "\n", F.lit("Current section context:"), F.when(given(title), F.concat(F.lit("- Heading: "), title)), F.when(given(purpose), F.concat(F.lit("- Purpose: "), purpose)),
        F.when(given(style_hint), F.concat(F.lit("- Style: "), style_hint)), F.lit("Write content that fits the purpose and follows the style. Do not repeat the heading."),
    )
    return F.when(given(title) | given(purpose) | given(style_hint), lines).otherwise("")


def humanize(name: Column) -> Column:
    """Camel or snake case as words that begin with a capital."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    words = F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


#: What names of states and events mean.
SUCCESS = r"success|complete|done|confirmed|stored|saved|ok\b|result"
CANCEL = r"cancel|closing|closed|unloaded|garbage|abort|exit|quit"
ERROR = r"error|invalid|fail|reject|missing|identical|warn"
BACK = r"(?i)\b(ESC|BACK|CANCEL|CLOSE|VETO|ABORT)\b"


def infer_role(name: Column) -> Column:
    """Role of a state by its name: success unless it also reads as cancelled, cancel, error, else screen."""
    low = F.lower(name)
    return F.when(low.rlike(SUCCESS) & ~low.rlike(CANCEL), "success").when(low.rlike(CANCEL), "cancel").when(low.rlike(ERROR), "error").otherwise("screen")


def infer_kind(source: Column, target: Column, events: Column) -> Column:
    """Edge kind: self, back if an event leads back, else forward."""
    return F.when(source == target, "self").when(F.array_join(events, " ").rlike(BACK), "back").otherwise("forward")


def split_label(label: Column) -> Column:
    """``(events, guards)`` of a transition label.

    Guards are the groups in square brackets. What is left is split at slashes and at two
    spaces or more; a part that begins with an upper-case word is an event, and a first part
    that does not is kept as the one thing known of the trigger.
    """
    guards = F.transform(F.regexp_extract_all(label, F.lit(r"\[([^\]]+)\]"), F.lit(1)), stripped)
    rest = stripped(F.regexp_replace(label, r"\[[^\]]+\]", ""))
    parts = F.filter(F.transform(F.split(rest, r"\s*/\s*|\s{2,}"), stripped), lambda p: p != "")
    events = F.filter(parts, lambda p, i: (i == 0) | p.rlike(r"^[A-Z][A-Z0-9_]*(\s|$)"))
    return F.struct(events.alias("events"), guards.alias("guards"))
