"""Text, URL and Markdown functions and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import signals as S
from ..functions import text as T
from . import Registry, table

R = Registry()


def _text(*parts: str) -> str:
    """Lines as one SQL text, for either engine."""
    return "concat(" + ", chr(10), ".join(parts) + ")"


#: Markdown made from a document: something for every pass, and the whole text.
MARKDOWN = _text(
    "'# Report ', cast(doc_id as string)",
    "'Intro -- by  ', lang, ' , see .Then More'",
    "'* first'",
    "'+ second'",
    "'3) third'",
    "'>quoted   words'",
    "'| a |  b|', source, '|'",
    "'|:--|--:|---|'",
    "'| 1 | ', cast(n_chars as string), ' | x |'",
    "'![](img/blue-sky_photo.v2.png) and [site] (http://x.org/', cast(doc_id as string), ')'",
    "'Cost $a_1 + b$ and $$E = mc^2$$ **bold** _it_ `code`'",
    "'## Next'",
    "text",
)
#: A text that is sometimes pseudo code.
PSEUDO = "concat(case when doc_id % 3 = 0 then concat('Algorithm ', cast(doc_id as string), ' Sort', chr(10)) else '' end, case when doc_id % 2 = 0 then concat('Require: a list', chr(10), '1: for each x do', chr(10), '2: if x ≤ y then return x', chr(10), '3: end for', chr(10)) else '' end, case when doc_id % 5 = 0 then concat('| a | b |', chr(10), '| - | - |', chr(10)) else '' end, text)"


def _made(spark, sf_dir, expr, name="md"):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(expr).alias(name))


WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _w(column: str) -> str:
    return f"len(list_filter(regexp_split_to_array({column}, '{WS}+'), lambda w: w <> ''))"


def _l(column: str) -> str:
    return f"string_split({column}, chr(10))"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def _lines_like(column: str, pattern: str) -> str:
    return f"len(list_filter({_l(column)}, lambda s: regexp_matches(s, '{pattern}')))"


@R.add("text_clean", f"select doc_id, trim(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '[\\x00-\\x1f\\x7f\\x{{80}}-\\x{{9f}}]', '', 'g')) as cleaned from documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@R.add("text_word_count", f"select lang, count(*) as docs, sum({_w('text')})::bigint as words, max({_w('text')}) as most from documents group by lang")
def text_word_count(spark, sf_dir):
    n = T.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("words"), F.max(n).alias("most"))


@R.add("text_emails", r"with f as (select doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') as x from documents) select doc_id, unnest(range(0, len(x)))::bigint as pos, unnest(x) as email from f")
def text_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.emails(F.col("text"))).alias("pos", "email")).select("doc_id", T.bigint(F.col("pos")).alias("pos"), "email")


_PHONES = " || ".join(f"regexp_extract_all(t, '{p}')" for p in (r"\b\d{3}-\d{3}-\d{4}\b", r"\b\(\d{3}\)\s*\d{3}-\d{4}\b", r"\b\d{3}\.\d{3}\.\d{4}\b", r"\b\d{10}\b"))
_NUMBERS = "concat(text, ' 555-', cast(100 + doc_id % 900 as string), '-1234 x(212) 555-0000 ', cast(1000000000 + doc_id as string), ' 100.200.3000')"


@R.add("text_phones", f"with m as (select doc_id, {_NUMBERS} as t from documents) select doc_id, array_to_string({_PHONES}, ',') as phones from m")
def text_phones(spark, sf_dir):
    return _made(spark, sf_dir, _NUMBERS, "t").select("doc_id", F.array_join(T.phone_numbers(F.col("t")), ",").alias("phones"))


_MARKED = "case page_id % 5 when 0 then url when 1 then concat(url, '?q=1&r=/x#top') when 2 then replace(url, 'https://', '') when 3 then 'mailto:a@b.c' else concat('//', cast(page_id as string), '.org/p') end"
_SPLIT = r"regexp_extract({0}, '^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', {1})"
_part = lambda u, k: _SPLIT.format(u, k)
_FULL = "case when regexp_matches(u, '^https?://') then u else 'https://' || u end"


@R.add(
    "url_checks",
    f"with m as (select page_id, {_MARKED} as u from pages), n as (select *, {_FULL} as f from m) select page_id, {_part('u', 1)} <> '' and {_part('u', 2)} <> '' as is_valid, case when {_part('u', 1)} = '' or {_part('u', 2)} = '' then 'Invalid URL format' end as problem, {_part('u', 2)} as domain, "
    f"{_part('f', 1)} || '://' || {_part('f', 2)} || {_part('f', 3)} || case when {_part('f', 4)} <> '' then '?' || {_part('f', 4)} else '' end as normalized, lower({_part('u', 1)}) in ('http', 'https') as is_web from n",
)
def url_checks(spark, sf_dir):
    u = F.col("u")
    made = table(spark, sf_dir, "pages").select("page_id", F.expr(_MARKED).alias("u"))
    return made.select("page_id", T.is_valid_url(u).alias("is_valid"), T.validate_url(u).alias("problem"), T.domain(u).alias("domain"), T.normalize_url(u).alias("normalized"), T.is_web_source(u).alias("is_web"))


@R.add("page_ranges", "with m as (select o_orderkey, (o_orderkey % 7 - 1)::int as a, (o_custkey % 9)::int as b, o_orderkey % 11 as k from orders) select o_orderkey, case when k = 0 then null when k = 1 then 'page range takes two numbers' when a < 0 or b < 0 then 'page numbers must not be negative' when a >= b then 'the first page must come before the last' end as problem, case when k = 0 then 0 else greatest(0, a) end as first_page, case when k in (0, 1) then 5 else least(5, b) end as last_page from m")
def page_ranges(spark, sf_dir):
    k = F.col("o_orderkey") % 11
    a, b = (F.col("o_orderkey") % 7 - 1).cast("int"), (F.col("o_custkey") % 9).cast("int")
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(a)).otherwise(F.array(a, b)).alias("r"))
    clamped = T.clamp_range(F.col("r"), F.lit(5))
    return made.select("o_orderkey", T.page_range_error(F.col("r")).alias("problem"), clamped["start"].alias("first_page"), clamped["end"].alias("last_page"))


@R.add("title_lines", f"with l as (select doc_id, unnest(range(0, len({_l('text')})))::bigint as pos, unnest({_l('text')}) as line from documents), w as (select *, list_filter(regexp_split_to_array(line, '{WS}+'), lambda w: w <> '') as ws from l) select doc_id, pos, line from w where len(ws) <= 8 and len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > len(ws) * 0.6")
def title_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return rows.where(T.title_like(F.col("line"))).select("doc_id", T.bigint(F.col("pos")).alias("pos"), "line")


@R.add("md_to_text", f"with m as (select doc_id, {MARKDOWN} as md from documents) select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\\[.*?\\]\\(.*?\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g'), '[*_]{{1,2}}([^*_]+)[*_]{{1,2}}', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), '(?m)^>\\s+', '', 'g'), '(?m)^\\s*[-*+]\\s+', '', 'g'), '(?m)^\\s*\\d+\\.\\s+', '', 'g'), ' ' || chr(10)) as plain from m")
def md_to_text(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.to_text(F.col("md")).alias("plain"))


@R.add("md_links", f"with m as (select doc_id, {MARKDOWN} as md from documents) select doc_id, regexp_replace(regexp_replace(md, '\\[([^\\]]+)\\]\\s*\\(\\s*([^\\s\\)]+)\\s*\\)', '[\\1](\\2)', 'g'), '\\[([^\\]]+)\\]\\s*\\n\\s*\\(([^\\)]+)\\)', '[\\1](\\2)', 'g') as tidy from m")
def md_links(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.tidy_links(F.col("md")).alias("tidy"))


@R.add("md_lists", f"with m as (select doc_id, {MARKDOWN} as md from documents) select doc_id, array_to_string(list_transform({_l('md')}, lambda s: regexp_replace(regexp_replace(s, '^(\\s*)[-*+]\\s*(.+)$', '\\1- \\2'), '^(\\s*)(\\d+)[.)]\\s*(.+)$', '\\1\\2. \\3')), chr(10)) as tidy from m")
def md_lists(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.tidy_lists(F.col("md")).alias("tidy"))


_H = "regexp_matches({0}, '^#{{1,6}}\\s')"


@R.add(
    "md_headings",
    f"with m as (select doc_id, {MARKDOWN} as md from documents), l as (select doc_id, unnest(range(0, len({_l('md')}))) as pos, unnest({_l('md')}) as s from m), n as (select *, lag(s) over w as p, lead(s) over w as f from l window w as (partition by doc_id order by pos)) "
    f"select doc_id, string_agg(case when {_H.format('s')} then case when trim(coalesce(p, '')) <> '' and not {_H.format('p')} then chr(10) else '' end || trim(s) || case when trim(coalesce(f, '')) <> '' then chr(10) else '' end else s end, chr(10) order by pos) as tidy from n group by doc_id",
)
def md_headings(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.tidy_headings(F.col("md")).alias("tidy"))


@R.add("md_quotes", f"with m as (select doc_id, {MARKDOWN} as md from documents) select doc_id, regexp_replace(regexp_replace(md, '(?m)^(\\s*)>\\s*(.+)$', '\\1> \\2', 'g'), '(?m)(^>.+$)', chr(10) || '\\1' || chr(10), 'g') as tidy from m")
def md_quotes(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.tidy_quotes(F.col("md")).alias("tidy"))


_CELLS = "list_transform(list_slice(string_split(s, '|'), 2, -2), lambda c: trim(c))"
_IS_RULE = "regexp_matches({0}, '^\\s*\\|[\\s:|-]*-[\\s:|-]*\\|\\s*$')"
_RULED = f"list_transform({_CELLS}, lambda c: case when c like ':%' and c like '%:' then ':---:' when c like '%:' then '---:' when c like '%:%' then ':---' else '---' end)"


@R.add(
    "md_tables",
    f"with m as (select doc_id, {MARKDOWN} as md from documents), l as (select doc_id, unnest(range(0, len({_l('md')}))) as pos, unnest({_l('md')}) as s from m), n as (select *, lead(s) over (partition by doc_id order by pos) as f from l) "
    f"select doc_id, string_agg(case when trim(s) like '|%|' then '| ' || array_to_string(case when {_IS_RULE.format('s')} and not coalesce({_IS_RULE.format('f')}, false) then {_RULED} else {_CELLS} end, ' | ') || ' |' else s end, chr(10) order by pos) as tidy from n group by doc_id",
)
def md_tables(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.tidy_tables(F.col("md")).alias("tidy"))


@R.add("md_clean_up", f"with m as (select doc_id, {MARKDOWN} || chr(10) || chr(10) || chr(10) || chr(10) || '<div class=\"x\">in  </div><td style=\"y\">z</td>   ' as md from documents) select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform({_l('md')}, lambda s: regexp_replace(s, '\\s+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '</?(?:table|tbody|thead|tfoot|tr|td|th)\\b[^>]*>', '', 'g'), '</?(?:div|span|svg|path|use|g|video|audio|picture|source|iframe|embed|object)\\b[^>]*>', '', 'g'), '\\s+class=\"[^\"]*\"', '', 'g'), '\\s+style=\"[^\"]*\"', '', 'g'), '\\s+aria-\\w+=\"[^\"]*\"', '', 'g'), ' ' || chr(10)) as tidy from m")
def md_clean_up(spark, sf_dir):
    more = f"concat({MARKDOWN}, chr(10), chr(10), chr(10), chr(10), '<div class=\"x\">in  </div><td style=\"y\">z</td>   ')"
    return _made(spark, sf_dir, more).select("doc_id", M.clean_up(F.col("md")).alias("tidy"))


_CLASS = "case when regexp_matches({0}, '^\\s*$') then 'empty' when regexp_matches({0}, '^#{{1,6}}\\s') then 'heading' when regexp_matches({0}, '^\\s*[-*+]\\s') or regexp_matches({0}, '^\\s*\\d+\\.\\s') then 'list_item' when regexp_matches({0}, '^\\s*\\|.*\\|\\s*$') then 'table_row' when regexp_matches({0}, '^\\s*>') then 'blockquote' when {0} like '```%' then 'code_fence' when regexp_matches({0}, '^---+\\s*$|^\\*\\*\\*+\\s*$|^___+\\s*$') then 'hr' else 'plain_text' end"


@R.add("md_line_classes", f"with m as (select doc_id, {MARKDOWN} as md from documents), l as (select unnest({_l('md')}) as s from m) select {_CLASS.format('s')} as line_class, count(*) as n, count_if(regexp_matches(s, '^\\s') and not regexp_matches(s, '^\\s*([-*+]|\\d+\\.)\\s'))::bigint as continued from l group by 1")
def md_line_classes(spark, sf_dir):
    rows = _made(spark, sf_dir, MARKDOWN).select(F.explode(T.lines(F.col("md"))).alias("s"))
    return rows.groupBy(M.line_class(F.col("s")).alias("line_class")).agg(F.count("*").alias("n"), F.count_if(M.continues_list(F.col("s"))).alias("continued"))


@R.add("md_typography", "select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, '--', '—'), ' {2,}', ' ', 'g'), '[ \\t]+([.!?:;,])', '\\1', 'g'), '([.!?])[ \\t]*([A-Z])', '\\1 \\2', 'g') as tidy from (select doc_id, concat(lang, ' -- a  b , c.Then ', text) as t from documents)")
def md_typography(spark, sf_dir):
    made = _made(spark, sf_dir, "concat(lang, ' -- a  b , c.Then ', text)")
    return made.select("doc_id", M.typography(F.col("md")).alias("tidy"))


@R.add("md_format")
def md_format(spark, sf_dir):
    """All passes; the regular expressions of the tests' SQL engine have no lookaround, so unit tests hold the results."""
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", M.format_markdown(F.col("md")).alias("formatted"))


@R.add("md_code_fence", f"select doc_id, '```algorithm' || chr(10) || array_to_string(list_transform({_l('text')}, lambda s: regexp_replace(s, '{WS}+$', '')), chr(10)) || chr(10) || '```' as fenced from documents")
def md_code_fence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.code_fence(F.col("text")).alias("fenced"))


@R.add("paragraph_breaks_by_sentence", f"with l as (select doc_id, unnest(range(0, len({_l('text')}))) as pos, unnest({_l('text')}) as s from documents), n as (select *, lead(s) over (partition by doc_id order by pos) as f from l) select doc_id, string_agg(s || case when regexp_matches(s, '[.?!:][ \\t]*$') and regexp_matches(coalesce(f, ''), '^[ \\t]*\\p{{Lu}}') then chr(10) else '' end, chr(10) order by pos) as spaced from n group by doc_id")
def paragraph_breaks_by_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.split_sentences_into_paragraphs(F.col("text")).alias("spaced"))


def _signals(c: str) -> dict[str, str]:
    return {
        "word_count": _w(c),
        "char_count": f"length({c})",
        "line_count": f"len({_l(c)})",
        "heading_count": _lines_like(c, r"^#{1,6}\s+"),
        "table_lines": _lines_like(c, r"^\s*\|"),
        "formula_block_count": _count(c, r"\$\$(?:.|\n)+?\$\$"),
        "code_fence_count": f"len({_count(c, '```')[4:-1]}) // 2",
        "image_count": _count(c, r"!\[.*?\]\(.*?\)"),
        "list_count": _lines_like(c, r"^\s*[-*+]\s+|^\s*\d+\.\s+"),
    }


_SIGNALS = ", ".join(f"{v} as {k}" for k, v in _signals("md").items())


@R.add("quality_signals", f"with m as (select doc_id, {MARKDOWN} as md from documents) select doc_id, {_SIGNALS} from m")
def quality_signals(spark, sf_dir):
    found = S.counters(F.col("md"))
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", *[found[n].alias(n) for n in _signals("md")])


@R.add("heuristic_score", f"with m as (select doc_id, {MARKDOWN} as md from documents), s as (select doc_id, {_SIGNALS}, 1 as formula_inline_count from m) select doc_id, round(word_count * 0.001 + heading_count * 5.0 + table_lines * 3.0 + formula_block_count * 10.0 + formula_inline_count * 2.0 + code_fence_count * 5.0 + image_count * 3.0, 6)::double as score from s")
def heuristic_score(spark, sf_dir):
    return _made(spark, sf_dir, MARKDOWN).select("doc_id", F.round(S.heuristic_score(F.col("md")), 6).alias("score"))


_TITLED = r"regexp_matches(trim(x, ' ' || chr(10)), '(?i)^(?:Algorithm|Procedure|Function|Subroutine|Listing)\s+\d+')"
_HEADED = r"regexp_matches(x, '(?im)^(?:Require|Ensure|Input|Output|Precondition|Postcondition)\s*:')"
_KEYS = r"(?i)(?:^|\s)(?:if\b|then\b|else\b|end\s+(?:if|for|while|function|procedure|loop)\b|for\s+(?:each|all)?\b|while\b|\bdo\b|repeat\b|until\b|return\b|function\b|procedure\b|begin\b|call\b)"


@R.add(
    "algorithm_score",
    f"with m as (select doc_id, {PSEUDO} as x from documents), f as (select *, list_filter({_l('x')}, lambda s: trim(s) <> '') as l, {_TITLED} as titled, {_HEADED} as headed, len(regexp_extract_all(x, '[←→≠≤≥∅▷◃∈∉∀∃⊂⊃∪∩∧∨≜≝≐⊕⊗]')) as signs from m), "
    f"g as (select *, len(list_filter(l, lambda s: regexp_matches(s, '^\\s*\\d+\\s*:\\s+\\S'))) as numbered, len(list_filter(l, lambda s: regexp_matches(regexp_replace(s, '[À-ɏ]', 'z', 'g'), '{_KEYS}'))) as keys, list_sum(list_transform(l, lambda s: length(s))) / len(l) as width from f), "
    "h as (select doc_id, case when len(l) = 0 or regexp_matches(x, '(?m)^\\|[\\s-]+\\|') then 0 else (case when titled then 5 else 0 end + case when headed then 3 else 0 end + least(numbered, 5) + least(keys, 5) + case when signs >= 2 then 2 else 0 end - case when width > 120 then 3 else 0 end - case when len(l) < 3 and not titled then 2 else 0 end - case when not (titled or headed or numbered >= 2 or signs >= 2) then 2 else 0 end) end::bigint as score from g) "
    "select doc_id, score, score >= 5 as is_algorithm from h",
)
def algorithm_score(spark, sf_dir):
    scored = _made(spark, sf_dir, PSEUDO).select("doc_id", S.algorithm_score(F.col("md")).alias("score"))
    return scored.withColumn("is_algorithm", F.col("score") >= 5)


@R.add("markdown_structure", f"with m as (select doc_id, case when doc_id % 4 = 0 then {MARKDOWN} else text end as x from documents), f as (select doc_id, regexp_matches(x, '(?m)^#{{1,6}}\\s+') as h, regexp_matches(x, '(?m)^\\s*[-*+]\\s+') as l, contains(x, '**') or contains(x, '__') as b, contains(x, '*') or contains(x, '_') as i, contains(x, '[') and contains(x, '](') as k, contains(x, '`') as c from m) select doc_id, h or (h::int + l::int + b::int + i::int + k::int + c::int) >= 2 as structured from f")
def markdown_structure(spark, sf_dir):
    return _made(spark, sf_dir, f"case when doc_id % 4 = 0 then {MARKDOWN} else text end").select("doc_id", S.has_markdown(F.col("md")).alias("structured"))


_CAPTION = "case doc_id % 6 when 0 then concat('Figure ', cast(doc_id as string), ': x') when 1 then 'fig. 2 shows' when 2 then '表 3 数据' when 3 then 'Tables 4' when 4 then concat(chr(10), ' Table 7', chr(10), 'more') else text end"


@R.add("captions", f"select doc_id, regexp_matches(trim(string_split(trim(x, ' ' || chr(10)), chr(10))[1]), '^(?:(?i:Figure|Fig\\.?|Image|Diagram|Chart|Graph|Illustration|Table|表)|图|插图|示意图|架构图|流程图)\\s*\\d+') as is_caption from (select doc_id, {_CAPTION} as x from documents)")
def captions(spark, sf_dir):
    return _made(spark, sf_dir, _CAPTION).select("doc_id", S.is_caption(F.col("md")).alias("is_caption"))


@R.add("page_metadata", f"with m as (select doc_id, {MARKDOWN} as md from documents) select doc_id, 'https://x.org/' || source as url, 'x.org' as domain, {_w('md')} as word_count, length(md) as character_count, {_count('md', chr(92) + '[([^' + chr(92) + ']]*)' + chr(92) + ']' + chr(92) + '(([^)]+)' + chr(92) + ')')} as link_count, {_count('md', '!' + chr(92) + '[([^' + chr(92) + ']]*)' + chr(92) + ']' + chr(92) + '(([^)]+)' + chr(92) + ')')} as image_ref_count from m join documents using (doc_id)")
def page_metadata(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://x.org/"), "source").alias("url"), F.expr(MARKDOWN).alias("md"))
    found = S.page_metadata(F.col("url"), F.lit(""), F.col("md"))
    return made.select("doc_id", *[found[n].alias(n) for n in ("url", "domain", "word_count", "character_count", "link_count", "image_ref_count")])
