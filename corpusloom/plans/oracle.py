"""DuckDB SQL with the same results as the core's queries."""

from __future__ import annotations

from corpusloom.functions import rules
from corpusloom.operators import search


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _distinct(x: str) -> str:
    """A list without repeats, first place first."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


_NAME = "split_part(file, '/', -1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '.(\\.[^.]+)$', 1))"


def _rule() -> str:
    cases = []
    for p in rules.IGNORED:
        if "*" in p:
            hit = f"regexp_matches({_NAME}, {_q('(?i)' + rules.glob_regex(p))}) or regexp_matches(file, {_q('(?i)' + rules.glob_regex(p))})"
        elif "/" in p:
            hit = f"contains('/' || file || '/', {_q('/' + p + '/')})"
        else:
            hit = f"list_contains(string_split(file, '/'), {_q(p)})" + (f" or {_SUFFIX} = {_q(p)}" if p.startswith(".") else "")
        cases.append(f"when {hit} then {_q(p)}")
    return "case " + " ".join(cases) + " end"


def _disposition() -> str:
    head = "hex(content)[1:16384]"
    pairs = f"regexp_extract_all({head}, '..')"
    control = f"len(list_filter({pairs}, lambda b: regexp_matches(b, '^(0[0-8BCEF]|1.)$')))"
    chars = f"case when try(decode(content)) is not null then len(list_filter({pairs}, lambda b: not regexp_matches(b, '^[89AB]'))) else len({pairs}) end"
    suffixes = ", ".join(map(_q, rules.BINARY_SUFFIXES))
    return f"""case when {_rule()} is not null then 'ignored' when {_SUFFIX} in ({suffixes}) then 'binary_suffix' when length > {rules.MOST_BYTES} then 'large' when content is null then 'unreadable'
        when length = 0 then 'empty' when list_contains({pairs}, '00') or {control} / greatest({chars}, 1) > {rules.MOST_CONTROL} then 'binary' else 'text' end"""


def _language() -> str:
    name = f"lower({_NAME})"
    cases = [f"when {name} = {_q(k)} then {_q(v)}" for k, v in rules.NAME_LANGUAGES.items()] + [f"when ends_with({name}, '.dockerfile') then 'dockerfile'"]
    first = "split_part(coalesce(text, ''), chr(10), 1)"
    cases += [f"when starts_with({first}, '#!') and contains({first}, {_q(w)}) then {_q(v)}" for w, v in rules.SHEBANG_LANGUAGES]
    cases += [f"when {_SUFFIX} = {_q(k)} then {_q(v)}" for k, v in rules.SUFFIX_LANGUAGES.items()]
    return "case " + " ".join(cases) + " else 'text' end"


_LINES = "string_split(regexp_replace(coalesce(text, ''), '\\n$', ''), chr(10))"
_WINDOWS = f"""(select *, case when n <= 60 then n else least(b + 50, n) end as e from (
    select *, len(l) as n, unnest(case when len(l) <= 60 then [0] else list_filter(range(0, len(l), 45), lambda b: b = 0 or b + 5 < len(l)) end) as b from (select *, {_LINES} as l from documents)))"""

_CLEAN = f"""array_to_string(list_filter(list_transform(string_split(coalesce(docstring, ''), chr(10)), lambda x: {_strip("regexp_replace(" + _strip("x") + ", '^(///|//|/\\*\\*|\\*/|\\*|#)', '')")}), lambda x: x <> ''), chr(10))"""


def _identifiers(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*'))"


_WORDS = f"""list_filter(list_transform(list_concat(list_concat(list_concat(regexp_extract_all(symbol_name, '[A-Za-z][a-z0-9]*'), regexp_split_to_array(symbol_name, '[._]')), list_concat({_identifiers("signature")}, {_identifiers("clean")})),
    flatten(list_transform(coalesce(imports, []), lambda i: {_identifiers("i")}))), lambda w: lower(w)), lambda w: length(w) >= 3 and not regexp_full_match(w, '[0-9]+') and w not in ({", ".join(map(_q, rules.STOP_WORDS))}))"""
_TOP = "[" + ", ".join(map(_q, rules.TOP_UP)) + "]"
_KEYWORDS = f"""(select * exclude (ws, ks), case when len(ks) >= 3 then ks else list_slice(list_concat(ks, list_filter({_TOP}, lambda t: not list_contains(ks, t))), 1, 3) end as kw
    from (select *, {_distinct("ws")} as ks from (select *, {_WORDS} as ws from (select *, {_CLEAN} as clean from (select distinct chunk_id, language, symbol_name, signature, docstring, imports from code_symbol)))))"""
_INPUTS = f"""list_filter(list_transform(string_split(regexp_extract(coalesce(signature, ''), '(?s)\\((.*)\\)', 1), ','), lambda a: {_strip("split_part(split_part(a, ':', 1), '=', 1)")}), lambda a: a <> '' and a not in ('self', 'this'))"""
_TAILS = f"""list_filter(list_transform(coalesce(imports, []), lambda i: {_strip("list_extract(regexp_split_to_array(i, '\\.|::| as '), -1)")}), lambda t: t <> '' and contains(coalesce(content, ''), t))"""
_ARROW = _strip("regexp_replace(regexp_extract(coalesce(signature, ''), '(?s)->(.*)$', 1), '[:{]\\s*$', '')")
_STATED = f"""list_transform(list_filter(list_transform(regexp_extract_all(coalesce(content, ''), '(?m)\\breturn[ \\t]+([^\\n;]+)', 1), lambda r: {_strip("regexp_replace(r, '(#|//).*$', '')")}), lambda r: r <> ''), lambda r: case when length(r) > 50 then r[1:47] || '...' else r end)"""


def _returns() -> str:
    said = _strip("regexp_extract(clean, '(?i)\\breturns?:[ \\t]*([^\\n]+)', 1)")
    prose = _strip("regexp_extract(clean, '(?i)\\breturns? ([^.\\n]+)', 1)")
    return f"coalesce(nullif({_ARROW}, ''), nullif({said}, ''), nullif({prose}, ''), nullif(array_to_string({_distinct('st')}, ', '), ''), 'nothing stated')"


def _none(words: str) -> str:
    return f"case when len({words}) > 0 then array_to_string({words}, ', ') else 'none' end"


_MEMBERS = """(select o.*, coalesce(m.members, []) as members from (select distinct repo, file, symbol_name, symbol_type, chunk_id, content, docstring, imports, parent_symbol, start_line from code_symbol where symbol_type in ('class', 'struct', 'trait', 'interface')) o
    left join (select repo, file, parent_symbol as symbol_name, list(split_part(child, '.', -1) order by start_line, split_part(child, '.', -1)) as members from
        (select distinct repo, file, parent_symbol, start_line, symbol_name as child from code_symbol where parent_symbol is not null) group by all) m using (repo, file, symbol_name))"""
_FLAG = "coalesce(exported, false) or coalesce(list_contains(exports, symbol_name) or list_contains(exports, split_part(symbol_name, '.', 1)), false)"
_REG = "name, url, status, indexed_at, symbol_count, file_count, embedding_count, index_version"


def _current(where: str = "true") -> str:
    return f"(select {_REG} from registry where {where} qualify row_number() over (partition by name order by indexed_at is not null desc, indexed_at desc, url desc nulls last, status desc nulls last, symbol_count desc nulls last, file_count desc nulls last, embedding_count desc nulls last, index_version desc nulls last) = 1)"


_BARE_URL = "regexp_replace(regexp_replace(trim(url), '\\.git$', ''), '/+$', '')"
_SECTIONS = f"""(select query_id, chunk_id, rank, 'Result ' || rank || chr(10) || 'Type: ' || coalesce(symbol_type, 'Unknown') || chr(10) || 'Name: ' || coalesce(symbol_name, 'Unknown') || chr(10) || 'File: ' || coalesce(file, 'Unknown') || chr(10) || 'Language: ' || coalesce(language, 'Unknown') || chr(10)
    || chr(10) || coalesce(retrieval_text, '') || chr(10) || chr(10) || repeat('-', 60) || chr(10) as section from (select *, repo || '/' || file as query_id, row_number() over (partition by repo, file order by chunk_id)::int as rank from
    (select distinct repo, chunk_id, symbol_type, symbol_name, file, language, retrieval_text from code_symbol where retrieval_text is not null)))"""
_RUNNING = f"(select *, sum(length(section)) over (partition by query_id order by rank) as used from {_SECTIONS})"
_KEPT = f"(select * from {_RUNNING} where used <= 12000)"
_CONTEXTS = f"(select query_id, {_q(search.HEAD)} || coalesce(string_agg(section, chr(10) order by rank) filter (used <= 12000), '') || {_q(search.TAIL)} as context from {_RUNNING} group by query_id)"


def _topk(score: str, order: str, name: str, searched: str = "true") -> str:
    return f"""select q.vec_id as query_id, e.vec_id, round({score}, 6) as {name}, row_number() over (partition by q.vec_id order by round({score}, 6) {order}, e.vec_id)::int as rank
        from (select distinct vec_id, embedding::double[] as a from embeddings where vec_id % 50 = 0) q, (select distinct vec_id, embedding::double[] as b from embeddings where {searched}) e qualify rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name; a query without one is tested against brute force instead."""
    symbols = lambda *c: f"(select distinct {', '.join(c)} from code_symbol)"
    source = "(select repo, file, any_value(content) as content, any_value(length) as length, any_value(text) as text from source_file group by repo, file)"
    return {
        "ignore_rule_first_match": f"select repo, file, {_rule()} as rule from (select distinct repo, file from source_file)",
        "ignored_by_rule": f"select repo, coalesce({_rule()}, '(kept)') as rule, count(*) as n_files from (select distinct repo, file from source_file) group by all",
        "file_disposition": f"select repo, file, {_disposition()} as disposition from {source}",
        "file_decode": f"select repo, file, md5(text) as text_md5 from {source}",
        "file_language": f"select repo, file, {_language()} as detected from {source}",
        "run_stats": f"select repo, count(*) as found, count(*) filter (x in ('text', 'empty')) as processed, count(*) filter (x = 'ignored') as ignored, count(*) filter (x = 'binary') as \"binary\", count(*) filter (x = 'large') as large from (select repo, {_disposition()} as x from {source}) group by repo",
        "chunk_windows": f"select doc_id, (b // 45)::int as chunk_index, b::int + 1 as start_line, e::int as end_line, md5(array_to_string(list_slice(l, b + 1, e), chr(10))) as content_md5 from {_WINDOWS}",
        "chunk_counts": f"select source, count(*) as n_chunks, sum(e - b)::bigint as n_lines from {_WINDOWS} group by source",
        "chunk_overview": f"""select chunk_id, case when len(hs) > 0 then {_strip("regexp_replace(hs[1], '^#+', '')")} when ls[1] <> '' then case when length(ls[1]) > 50 then ls[1][1:47] || '...' else ls[1] end else 'untitled part' end as title,
            case when length(t) > 200 then {_strip("t[1:197]")} || '...' else t end as summary from (select *, list_filter(ls, lambda x: starts_with(x, '#')) as hs, case when clean <> '' then clean else content end as t
            from (select *, list_transform(string_split(content, chr(10)), lambda x: {_strip("x")}) as ls, {_CLEAN} as clean from {symbols("chunk_id", "symbol_type", "content", "docstring")} where symbol_type = 'chunk' and content is not null))""",
        "symbol_ids": f"select repo || '::' || file || '::' || symbol_name || '::' || start_line as chunk_id, repo || '::' || file || '::' || symbol_name as symbol_id from {symbols('repo', 'file', 'symbol_name', 'start_line')}",
        "retrieval_sentence": f"""select chunk_id, upper(language[1]) || lower(language[2:]) || ' ' || symbol_type || ' ''' || symbol_name || '''' || case when parent_symbol is not null then ' in class ''' || parent_symbol || '''' else '' end || ' defined in ' || file || '.' as sentence
            from {symbols("chunk_id", "language", "symbol_type", "symbol_name", "parent_symbol", "file")}""",
        "docstring_clean": f"select chunk_id, {_CLEAN} as clean from {symbols('chunk_id', 'docstring')}",
        "keywords_ordered": f"select chunk_id, array_to_string(kw, ' ') as keywords from {_KEYWORDS}",
        "keyword_counts": f"select language, keyword, count(*) as n_symbols from (select language, unnest(kw) as keyword from {_KEYWORDS}) group by all",
        "signature_inputs": f"select chunk_id, array_to_string({_INPUTS}, ', ') as inputs from {symbols('chunk_id', 'signature')}",
        "signature_returns": f"select chunk_id, {_returns()} as gives from (select *, {_CLEAN} as clean, {_STATED} as st from {symbols('chunk_id', 'symbol_type', 'signature', 'content', 'docstring')} where symbol_type in ('function', 'method'))",
        "dependency_match": f"select chunk_id, array_to_string({_distinct('ts')}, ', ') as dependencies from (select *, {_TAILS} as ts from {symbols('chunk_id', 'content', 'imports')})",
        "function_descriptions": f"""select chunk_id, md5(case when parent_symbol is not null then 'method ' else 'function ' end || symbol_name || ' of ' || repo || '/' || file || case when parent_symbol is not null then ' inside ' || parent_symbol else '' end
            || chr(10) || 'about: ' || case when clean <> '' then clean else 'not documented' end || chr(10) || 'header: ' || coalesce(signature, '') || chr(10) || 'takes: ' || {_none("ins")} || chr(10) || 'gives: ' || {_returns()} || chr(10) || 'uses: ' || {_none("deps")}) as description_md5
            from (select *, {_distinct("ts")} as deps from (select *, {_CLEAN} as clean, {_STATED} as st, {_INPUTS} as ins, {_TAILS} as ts from {symbols("chunk_id", "symbol_type", "repo", "file", "symbol_name", "parent_symbol", "signature", "content", "docstring", "imports")} where symbol_type in ('function', 'method')))""",
        "class_members_join": f"select chunk_id, array_to_string(members, ', ') as members, len(members)::int as n_members from {_MEMBERS}",
        "class_descriptions": f"""select chunk_id, md5(symbol_type || ' ' || symbol_name || ' of ' || repo || '/' || file || chr(10) || 'about: ' || case when clean <> '' then clean else 'not documented' end
            || chr(10) || 'members: ' || {_none("members")} || chr(10) || 'uses: ' || {_none("deps")}) as description_md5 from (select *, {_distinct("ts")} as deps from (select *, {_CLEAN} as clean, {_TAILS} as ts from {_MEMBERS}))""",
        "export_flags": f"select chunk_id, {_FLAG} as is_exported, ({_FLAG}) and not coalesce(exported, false) as flipped from {symbols('chunk_id', 'symbol_name', 'exported', 'exports')}",
        "candidates": f"select chunk_id, symbol_type from {symbols('chunk_id', 'symbol_type', 'embedding_candidate')} where embedding_candidate and symbol_type in ({', '.join(map(_q, rules.CANDIDATE_TYPES))})",
        "language_breakdown": f"select repo, coalesce(language, 'unknown') as language, count(*) as n_symbols from {symbols('repo', 'chunk_id', 'language')} group by all",
        "languages_sorted": "select repo, string_agg(distinct language, ',' order by language) as languages from code_symbol group by repo",
        "type_pivot": f"""select repo, count(*) filter (symbol_type in ('function', 'async_function', 'arrow_function')) as functions, count(*) filter (symbol_type in ('class', 'interface')) as classes, count(*) filter (symbol_type = 'method') as methods, count(*) filter (symbol_type = 'struct') as structs,
            count(*) filter (symbol_type = 'enum') as enums, count(*) filter (symbol_type = 'trait') as traits, count(*) filter (symbol_type = 'chunk') as chunks from {symbols("repo", "chunk_id", "symbol_type")} group by repo""",
        "type_counts": "select repo, symbol_type, count(distinct chunk_id) as n_symbols from code_symbol group by all",
        "cleaning_counts": f"""select repo, count(*) as raw, count(*) filter (symbol_type = 'import') as imports_removed, count(*) filter (symbol_type = 'export') as exports_removed, count(*) filter (({_FLAG}) and not coalesce(exported, false)) as flipped,
            count(*) filter (symbol_type is null or symbol_type not in ('import', 'export')) as total_symbols from {symbols("repo", "chunk_id", "symbol_name", "symbol_type", "exported", "exports")} group by repo""",
        "registry_counts": """with s as (select repo as name, count(distinct chunk_id) as n from code_symbol group by all), f as (select repo as name, count(distinct file) as n from source_file group by all), i as (select repo as name, count(distinct symbol_id) as n from indexed_dataset group by all)
            select name, coalesce(s.n, 0) as symbol_count, coalesce(f.n, 0) as file_count, coalesce(i.n, 0) as embedding_count from s full join f using (name) full join i using (name)""",
        "symbol_stats": f"""select repo, count(*) as total_symbols, count(parent_symbol) as with_parent, count(*) filter (embedding_candidate) as candidates, count(*) filter ({_FLAG}) as exported, count(*) filter (({_FLAG}) and not coalesce(exported, false)) as flipped, max((symbol_type = 'chunk')::int) as large_chunked
            from {symbols("repo", "chunk_id", "symbol_name", "symbol_type", "parent_symbol", "embedding_candidate", "exported", "exports")} group by repo""",
        "parse_failures": "select repo, language, count(*) as n_files, count(*) filter (failed) as n_failed from (select repo, file, language, coalesce(bool_or(metadata.ast_parse_failure), false) as failed from code_symbol group by all) group by repo, language",
        "repo_name_from_url": f"select url, nullif(split_part(regexp_replace({_BARE_URL}, '[?#].*$', ''), '/', -1), '') as repo_name from (select distinct url from registry)",
        "url_normalise": f"select lower({_BARE_URL}) as normal_url, count(*) as n_spellings from (select distinct url from registry where url is not null) group by all",
        "registry_current": f"select * from {_current()}",
        "registry_upsert": f"with late as {_current('indexed_at >= timestamp ' + _q('2025-08-01'))} select * from late union all select * from {_current('indexed_at is null or indexed_at < timestamp ' + _q('2025-08-01'))} where name not in (select name from late)",
        "registry_change": f"select name, url, status, indexed_at, coalesce(n, symbol_count) as symbol_count, file_count, embedding_count, index_version from {_current()} left join (select repo as name, count(distinct chunk_id) as n from code_symbol group by repo) using (name)",
        "registry_register": f"select {_REG} from {_current()} where name not in (select repo from source_file) union all select distinct repo, null, 'indexing', null::timestamp, 0, 0, 0, null from source_file",
        "registry_semi": "select repo, count(distinct file) as n_files from source_file where repo in (select name from registry where status = 'indexed') group by repo",
        "registry_anti": "select distinct name from registry where name not in (select repo from indexed_dataset)",
        "delete_cascade": f"""with gone as (select name from {_current()} where url is null) select repo, n_symbols, coalesce(n_indexed, 0) as n_indexed from (select repo, count(distinct chunk_id) as n_symbols from code_symbol group by repo)
            left join (select repo, count(distinct symbol_id) as n_indexed from indexed_dataset group by repo) using (repo) where repo not in (select name from gone)""",
        "index_upsert": """with fresh as (select symbol_id, repo, symbol_name, symbol_type, retrieval_text from code_symbol where embedding_candidate and retrieval_text is not null qualify row_number() over (partition by symbol_id order by start_line, retrieval_text) = 1)
            select symbol_id, repo, symbol_name, symbol_type, md5(retrieval_text) as text_md5 from fresh union all select symbol_id, repo, symbol_name, symbol_type, md5(coalesce(retrieval_text, '')) from (select * from indexed_dataset qualify row_number() over (partition by symbol_id order by coalesce(retrieval_text, '') desc) = 1)
            where symbol_id not in (select symbol_id from fresh)""",
        "cosine_topk": _topk("list_cosine_similarity(a, b)", "desc", "cosine"),
        "cosine_topk_filtered": _topk("list_cosine_similarity(a, b)", "desc", "cosine", "label % 2 = 1"),
        "cosine_topk_by_label": """select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(a, b), 6) as cosine, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(a, b), 6) desc, e.vec_id)::int as rank
            from (select distinct vec_id, embedding::double[] as a, label from embeddings where vec_id % 50 = 0) q join (select distinct vec_id, embedding::double[] as b, label from embeddings) e on q.label = e.label qualify rank <= 5""",
        "l2_topk": _topk("list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "asc", "distance"),
        "context_budget": f"select query_id, chunk_id, rank, used::bigint as used from {_KEPT}",
        "context_string": f"select query_id, length(context)::int as n_chars, md5(context) as context_md5 from {_CONTEXTS}",
        "prompt_build": f"select query_id, md5({_q(search.SYSTEM)} || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || 'What does ' || query_id || ' do?' || chr(10) || chr(10) || 'Answer:') as prompt_md5 from {_CONTEXTS}",
    }
