"""Scalar text functions as Column expressions: terms, names, keys, dates, citations and JSON picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Particles and endings that queries carry, and endings of rule names.
LONG_PARTICLES = ("에서", "에게", "으로", "로서", "로써")
SHORT_PARTICLES = "상의은는이가을를:,，"
END_MARKS = "?!.,:;，。"
RULE_ENDINGS = ("규정", "규칙", "강령", "정관", "조례", "법", "시행령", "시행규칙")
INACTIVE = ("superseded", "repealed", "inactive", "replaced", "abolished", "폐지", "실효", "대체")
#: Words before an institution's name that people leave out; callers add those of their region.
NAME_PREFIXES = ("한국", "재단법인", "(재)", "재단")
_PUNCT = r"[!-/:-@\[-`{-~]+"
_QUOTES = "“”‘’「」『』"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, case kept."""
    return F.filter(F.split(_col(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trim_particles(x: Column) -> Column:
    return F.regexp_replace(x, f"[{SHORT_PARTICLES}]+$", "")


def strip_particles(x: Column) -> Column:
    """Drops end marks, then one long particle, or else all short ones."""
    bare = F.regexp_replace(x, f"[{END_MARKS}]+$", "")
    long = "|".join(LONG_PARTICLES)
    return F.when(bare.rlike(f"({long})$"), F.substring(bare, F.lit(1), F.length(bare) - 2)).otherwise(trim_particles(bare))


def trim_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_PUNCT}|{_PUNCT}$", "")


def query_terms(q: Column | str) -> Column:
    """Search terms of a question: each word as it stands and without particles, two characters at least, first seen first."""
    both = F.flatten(F.transform(words(q), lambda w: F.array(trim_punctuation(w), strip_particles(w))))
    return F.array_distinct(F.filter(both, lambda t: F.length(t) >= 2))


def rule_terms(terms: Column) -> Column:
    """Those terms that look like the name of a rule."""
    return F.filter(terms, lambda t: t.rlike(f"({'|'.join(RULE_ENDINGS)})$"))


def lexical_terms(text: Column | str) -> Column:
    """Lower-cased words without punctuation or quotation marks at their ends."""
    edge = rf"[!-/:-@\[-`{{-~{_QUOTES}]+"
    return F.filter(F.transform(words(F.lower(_col(text))), lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", "")), lambda w: w != "")


def slugify(name: Column | str) -> Column:
    """A rule's name without spaces and signs; a digest if nothing is left. Expects composed (NFC) text."""
    kept = F.regexp_replace(F.regexp_replace(_col(name), r"(?U)\s+", ""), r"(?U)[^\wㄱ-ㆎ·ㆍ․.\-]+", "")
    return F.when(kept == "", F.left(F.sha2(_col(name), 256), F.lit(12))).otherwise(kept)


def alias_key(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(name), r"(?U)[\s\-_·]+", ""))


def aliases(slug: Column, label: Column, prefixes: tuple[str, ...] = NAME_PREFIXES) -> Column:
    """Names of an institution: slug, label, and the label without a customary prefix if three characters are left."""
    short = [F.when(label.startswith(p) & (F.length(label) - len(p) >= 3), F.substring(label, F.lit(len(p) + 1), F.length(label))) for p in prefixes]
    return F.array_distinct(F.filter(F.array(slug, label, *short), lambda x: x.isNotNull() & (x != "")))


def normalize_spaces(text: Column | str) -> Column:
    """No-break space to space, the private-use quote to a quote, runs of blanks to one."""
    return F.regexp_replace(F.translate(_col(text), "\u00a0\uf000", ' "'), r"[ \t]+", " ")


def normalize_title(text: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.translate(normalize_spaces(text), "․", "·"), r"(?U)\s+", " "))


def normalize_question(text: Column | str) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def is_active(status: Column | str) -> Column:
    return ~F.lower(F.coalesce(_col(status), F.lit(""))).rlike("|".join(INACTIVE))


def blank_to_null(x: Column | str) -> Column:
    t = F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def article_ref(q: Column | str) -> Column:
    """First article number in a question as struct(prefix, article, next): what stands before, the label, what follows."""
    q = _col(q)
    article = F.regexp_extract(q, r"제[0-9]+조(의[0-9]+)?", 0)
    at = F.instr(q, article)
    rest = F.substring(q, at + F.length(article), F.lit(1))
    return F.when(article != "", F.struct(F.substring(q, F.lit(1), at - 1).alias("prefix"), article.alias("article"), rest.alias("next")))


def direct_article(q: Column | str, fallback_rule: Column | None = None) -> Column:
    """struct(rule slug, article) that a question points at, or null."""
    ref = article_ref(q)
    last = F.element_at(words(ref["prefix"]), -1)
    last = F.when(F.size(words(ref["prefix"])) > 0, trim_particles(last))
    rule = F.coalesce(F.when(last != "", last), fallback_rule if fallback_rule is not None else F.lit(None).cast("string"))
    ok = ref.isNotNull() & rule.isNotNull() & ~ref["next"].rlike("^[0-9의]$")
    return F.when(ok, F.struct(slugify(rule).alias("rule"), ref["article"].alias("article")))


def direct_annex(q: Column | str) -> Column:
    """struct(prefix, label) of the first annex number in a question, or null."""
    q = _col(q)
    hit = F.regexp_extract(q, r"(?U)별표\s*[0-9\-]+|별지\s*(제\s*)?[0-9\-]+", 0)
    number = F.regexp_extract(hit, r"[0-9\-]+$", 0)
    label = F.when(hit.startswith("별표"), F.concat(F.lit("별표"), number)).otherwise(F.concat(F.lit("별지제"), number, F.lit("호")))
    return F.when(hit != "", F.struct(F.substring(q, F.lit(1), F.instr(q, hit) - 1).alias("prefix"), label.alias("label")))


def article_key(number: Column, sub: Column) -> Column:
    """제N조 or 제N조의M without leading zeros."""
    return F.concat(F.lit("제"), number.cast("int").cast("string"), F.lit("조"), F.when(F.coalesce(sub, F.lit("")) != "", F.concat(F.lit("의"), sub.cast("int").cast("string"))).otherwise(""))


def article_order(label: Column | str) -> Column:
    """struct(N, M, label) by which articles sort: 제19조 < 제19조의2 < 제20조."""
    x = _col(label)
    head = F.substring_index(F.substring_index(x, "조", 1), "의", 1)
    tail = F.when(x.contains("의"), F.regexp_extract(F.substring(x, F.instr(x, "의") + 1, F.length(x)), "^[0-9]+", 0))
    n = F.coalesce(F.regexp_replace(head, "[^0-9]", "").try_cast("long"), F.lit(0))
    return F.struct(n.alias("n"), F.coalesce(tail.try_cast("long"), F.lit(0)).alias("m"), x.alias("label"))


def latest_date(text: Column | str) -> Column:
    """The latest valid date written YYYY.M.D in a text, as YYYY-MM-DD, or null."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(?:19|20)[0-9]{2}\.\s*[0-9]{1,2}\s*\.\s*[0-9]{1,2}"), F.lit(0))
    dates = F.transform(found, lambda d: F.try_to_date(F.regexp_replace(d, r"\s+", ""), "y.M.d"))
    return F.array_max(dates).cast("string")


def ref_type(window: Column) -> Column:
    return F.when(window.contains("준용"), "준용").when(window.contains("위임"), "위임").when(window.contains("단서") | window.contains("예외"), "단서예외").otherwise("인용")


def edge_kind(kind: Column | str) -> Column:
    k = _col(kind)
    return F.when(k == "준용", "ApplyMutatis").when(k == "위임", "Delegates").when(k == "단서예외", "ExceptWhen").otherwise("Cites")


def printed_page(text: Column | str) -> Column:
    """The page number printed in a page's first or last five lines that are not blank: '- 12 -' or '12' alone."""
    lines = F.filter(F.transform(F.split(_col(text), "\n"), lambda x: F.btrim(normalize_spaces(x))), lambda x: x != "")
    near = F.concat(F.slice(lines, 1, 5), F.when(F.size(lines) > 5, F.slice(lines, -5, 5)).otherwise(lines))
    hits = F.filter(F.transform(near, lambda x: F.regexp_extract(x, r"^(?:-\s*)?([0-9]{1,4})(?:\s*-)?$", 1)), lambda x: x != "")
    return F.get(hits, F.lit(0)).try_cast("int")


def clean_page(text: Column | str, footers: tuple[str, ...] = ()) -> Column:
    """A page without its number line and footers."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.rtrim(normalize_spaces(x)))
    kept = F.filter(lines, lambda x: ~F.btrim(x).rlike(r"^-\s*[0-9]+\s*-$") & ~F.btrim(x).isin(*footers, "\0"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "")


def comparable_heading(text: Column | str) -> Column:
    t = F.regexp_replace(normalize_title(text), r"^[0-9IVX]+\s*[-.]\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"^(?:제\s*)?[0-9]+\s*[편장절]\s*", ""), r"(?U)[\s·ㆍ․]+", "")


def table_sensitive(body: Column | str) -> Column:
    """Texts whose tables a plain extraction may have spoilt."""
    b = _col(body)
    marked = F.lit(False)
    for m in ("[별표", "<별표", "별 표", "[별지", "<별지", "No."):
        marked = marked | b.contains(m)
    return marked | (F.size(F.filter(F.split(b, "\n"), lambda x: F.length(F.btrim(x)).between(1, 4))) >= 10)


def inline_annex_tail(tail: Column) -> Column:
    """An annex heading followed by such a particle is a mention, not a heading."""
    return tail.rlike(r"^(?:에|의)(?:\s|한|하여|해|의|를|을|로|으로|$)")


def table_markdown(rows: Column) -> Column:
    """A Markdown table from an array of arrays of strings: blank rows dropped, short ones padded, cells escaped."""
    cell = lambda c: F.replace(F.replace(F.btrim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.btrim(F.coalesce(c, F.lit(""))) != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    padded = F.transform(full, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(F.sequence(F.lit(1), width), lambda i: F.lit("---")))
    lines = F.transform(padded, line)
    return F.when(F.size(full) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise("")


def page_range(pages: Column) -> Column:
    """'' | 'a' | 'a-b' from a list of pages, of which two count."""
    s = lambda i: F.get(pages, F.lit(i)).cast("string")
    return F.when(F.size(pages) > 1, F.concat(s(0), F.lit("-"), s(1))).when(F.size(pages) == 1, s(0)).otherwise("")


def expand_pages(pages: Column) -> Column:
    """All pages of a [first, last] pair; both ends of an inverted one."""
    a, b = F.get(pages, F.lit(0)), F.get(pages, F.lit(1))
    return F.when(F.size(pages) == 0, F.array().cast("array<int>")).when(F.size(pages) == 1, F.array(a)).when(a <= b, F.sequence(a, b)).otherwise(F.array(a, b))


def citation_labels(text: Column | str) -> Column:
    """Bracketed citations [rule#제N조의M] of an answer, first seen first."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"\[([^\]\n#]+#제[0-9]+조(?:의[0-9]+)?)\]"), F.lit(1)))


def answer_refs(text: Column | str) -> Column:
    """Words of an answer that are article ids."""
    found = F.split(_col(text), r"""(?U)[\s\[\](),.;:"'“”]+""")
    return F.array_distinct(F.filter(found, lambda w: w.contains("#제") & w.contains("조")))


def json_delta(line: Column | str) -> Column:
    """The text that a streamed line carries; the line itself if it is no JSON; null at the end of a stream."""
    x = _col(line)
    parsed = F.try_parse_json(x)
    at = [F.get_json_object(x, f"$.{p}") for p in ("delta.content", "delta", "content", "message.content", "text", "choices[0].delta.content")]
    plain = [F.when(~a.startswith("{"), a) for a in at]
    return F.when(parsed.isNull(), x).when(F.get_json_object(x, "$.done") == "true", F.lit(None)).otherwise(F.coalesce(*plain))


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(text), r"\n{2,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def preview(text: Column | str, n: int = 42) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


def last_chars(text: Column | str, n: int = 500) -> Column:
    return F.right(_col(text), F.lit(n))


def error_tail(text: Column | str, markers: tuple[str, ...]) -> Column:
    """The last line that holds one of the markers."""
    return F.element_at(F.filter(F.split(_col(text), "\n"), lambda x: x.rlike("|".join(markers))), -1)


def append_once(text: Column | str, notice: str) -> Column:
    t = _col(text)
    return F.when(t.contains(notice), t).otherwise(F.concat(F.rtrim(t), F.lit("\n\n" + notice)))


def yaml_scalar(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def is_slug(x: Column | str) -> Column:
    """Lower-case letters, digits and inner single hyphens."""
    return F.coalesce(_col(x).rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def is_date(x: Column | str) -> Column:
    """A day of the calendar written YYYY-MM-DD."""
    c = _col(x)
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def safe_path(path: Column | str) -> Column:
    """Relative, not empty, without '..' or '.' parts."""
    p = _col(path)
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.{1,2}(/|$)") & ~p.contains("\\")
