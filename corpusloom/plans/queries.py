"""Registered queries of the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import files as ff
from corpusloom.functions import rules
from corpusloom.functions import text as ft
from corpusloom.operators import chunks, members, registry, search, symbols
from corpusloom.sources.tables import evenly, table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct rows of narrow columns; what reads `content` makes its result first and drops repeats then."""
    return table(spark, d, "code_symbol", *columns).distinct()


# ---------------------------------------------------------------- files
@query
def ignore_rule_first_match(spark, d):
    """The first ignore rule of each file."""
    return table(spark, d, "source_file", "repo", "file").distinct().select("repo", "file", ff.ignore_rule(F.col("file")).alias("rule"))


@query
def ignored_by_rule(spark, d):
    """Files per ignore rule and repository."""
    once = table(spark, d, "source_file", "repo", "file").distinct().withColumn("rule", F.coalesce(ff.ignore_rule(F.col("file")), F.lit("(kept)")))
    return once.groupBy("repo", "rule").agg(F.count("*").alias("n_files"))


@query
def file_disposition(spark, d):
    """What becomes of each file before it is read."""
    f = table(spark, d, "source_file", "repo", "file", "content", "length")
    return f.select("repo", "file", ff.disposition(F.col("file"), F.col("content"), F.col("length")).alias("disposition")).dropDuplicates(["repo", "file"])


@query
def file_decode(spark, d):
    """Decoded text of each file's bytes, as its md5."""
    f = table(spark, d, "source_file", "repo", "file", "content")
    return f.select("repo", "file", F.md5(ff.decoded(F.col("content"))).alias("text_md5")).dropDuplicates(["repo", "file"])


@query
def file_language(spark, d):
    """The language of each file by name, first line and suffix."""
    f = table(spark, d, "source_file", "repo", "file", "text")
    return f.select("repo", "file", ff.language(F.col("file"), F.col("text")).alias("detected")).dropDuplicates(["repo", "file"])


@query
def run_stats(spark, d):
    """Counters of one run over each repository's files."""
    f = table(spark, d, "source_file", "repo", "file", "content", "length")
    x = f.select("repo", "file", ff.disposition(F.col("file"), F.col("content"), F.col("length")).alias("disposition")).dropDuplicates(["repo", "file"])
    is_ = lambda v: F.count_if(F.col("disposition") == v)
    return x.groupBy("repo").agg(F.count("*").alias("found"), F.count_if(F.col("disposition").isin("text", "empty")).alias("processed"), is_("ignored").alias("ignored"), is_("binary").alias("binary"), is_("large").alias("large"))


# ---------------------------------------------------------------- chunks
@query
def chunk_windows(spark, d):
    """Overlapping windows of lines over every document."""
    w = chunks.fixed_windows(table(spark, d, "documents", "doc_id", "text"))
    return w.select("doc_id", "chunk_index", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query
def chunk_counts(spark, d):
    """Chunks and lines per document source."""
    w = chunks.fixed_windows(table(spark, d, "documents", "source", "doc_id", "text"))
    return w.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


@query
def chunk_paragraphs(spark, d):
    """Paragraph- and heading-aware chunks of every document."""
    docs = table(spark, d, "documents", "doc_id", "text", "doc_type").withColumn("md", F.col("doc_type").isin("readme", "guide", "changelog"))
    return chunks.chunks(docs.select("doc_id", "text", "md"), markdown="md").select("doc_id", "chunk_index", "total_chunks", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query
def chunk_overview(spark, d):
    """Title and summary of every chunk symbol."""
    s = table(spark, d, "code_symbol", "chunk_id", "symbol_type", "content", "docstring").where("symbol_type = 'chunk' and content is not null")
    return s.select("chunk_id", ft.chunk_title(F.col("content")).alias("title"), ft.chunk_summary(F.col("content"), F.col("docstring")).alias("summary")).distinct()


# ---------------------------------------------------------------- symbols
@query
def extracted_symbols(spark, d):
    """Symbols of every source file by its language's parser, chunks where there is none."""
    f = table(spark, d, "source_file", "repo", "file", "language", "text")
    found = symbols.symbols(evenly(f)).select("chunk_id", "symbol_id", "symbol_type", "symbol_name", "parent_symbol", "start_line", "end_line", "signature", "is_async", "ast_parse_failure", "imports", "exports")
    return found.distinct()


@query
def symbol_ids(spark, d):
    """Ids built from their parts."""
    s = _symbols(spark, d, "repo", "file", "symbol_name", "start_line")
    return s.select(ft.chunk_id(*map(F.col, ("repo", "file", "symbol_name", "start_line"))).alias("chunk_id"), ft.symbol_id(*map(F.col, ("repo", "file", "symbol_name"))).alias("symbol_id"))


@query
def retrieval_sentence(spark, d):
    """One sentence per symbol."""
    s = _symbols(spark, d, "chunk_id", "language", "symbol_type", "symbol_name", "parent_symbol", "file")
    return s.select("chunk_id", ft.retrieval_sentence(*map(F.col, ("language", "symbol_type", "symbol_name", "parent_symbol", "file"))).alias("sentence"))


@query
def docstring_clean(spark, d):
    """Documentation without markers."""
    s = _symbols(spark, d, "chunk_id", "docstring")
    return s.select("chunk_id", ft.clean_docstring(F.col("docstring")).alias("clean"))


@query
def keywords_ordered(spark, d):
    """Keywords of every symbol in order."""
    s = _symbols(spark, d, "chunk_id", "symbol_name", "signature", "docstring", "imports")
    return s.select("chunk_id", F.array_join(ft.keywords(F.col("symbol_name"), F.col("signature"), ft.clean_docstring(F.col("docstring")), F.col("imports")), " ").alias("keywords"))


@query
def keyword_counts(spark, d):
    """Symbols per keyword and language."""
    s = _symbols(spark, d, "chunk_id", "language", "symbol_name", "signature", "docstring", "imports")
    k = s.select("language", F.explode(ft.keywords(F.col("symbol_name"), F.col("signature"), ft.clean_docstring(F.col("docstring")), F.col("imports"))).alias("keyword"))
    return k.groupBy("language", "keyword").agg(F.count("*").alias("n_symbols"))


@query
def signature_inputs(spark, d):
    """Argument names of every signature."""
    s = _symbols(spark, d, "chunk_id", "signature")
    return s.select("chunk_id", F.array_join(ft.inputs(F.col("signature")), ", ").alias("inputs"))


@query
def signature_returns(spark, d):
    """What every function gives."""
    s = table(spark, d, "code_symbol", "chunk_id", "symbol_type", "signature", "content", "docstring").where("symbol_type in ('function', 'method')")
    return s.select("chunk_id", ft.returns(F.col("signature"), F.col("content"), ft.clean_docstring(F.col("docstring"))).alias("gives")).distinct()


@query
def dependency_match(spark, d):
    """Imports that a symbol's content mentions."""
    s = table(spark, d, "code_symbol", "chunk_id", "content", "imports")
    return s.select("chunk_id", F.array_join(ft.dependencies(F.col("content"), F.col("imports")), ", ").alias("dependencies")).distinct()


@query
def function_descriptions(spark, d):
    """Descriptions of functions and methods, as md5."""
    names = ("repo", "file", "symbol_name", "parent_symbol", "signature", "content", "docstring", "imports")
    s = table(spark, d, "code_symbol", "chunk_id", "symbol_type", *names).where("symbol_type in ('function', 'method')")
    return s.select("chunk_id", F.md5(ft.function_description({n: F.col(n) for n in names})).alias("description_md5")).distinct()


@query
def class_members_join(spark, d):
    """Class-like symbols with their members in source order."""
    s = _symbols(spark, d, "chunk_id", "repo", "file", "symbol_type", "symbol_name", "parent_symbol", "start_line")
    return members.with_members(s).select("chunk_id", F.array_join("members", ", ").alias("members"), F.size("members").alias("n_members"))


@query
def class_descriptions(spark, d):
    """Descriptions of class-like symbols, as md5."""
    names = ("repo", "file", "symbol_name", "symbol_type", "docstring", "uses")
    s = table(spark, d, "code_symbol", "chunk_id", "parent_symbol", "start_line", "content", "imports", *names[:-1])
    s = s.withColumn("uses", ft.dependencies(F.col("content"), F.col("imports"))).drop("content", "imports").distinct()
    m = members.with_members(s)
    return m.select("chunk_id", F.md5(ft.class_description({n: F.col(n) for n in names}, F.col("members"))).alias("description_md5"))


@query
def export_flags(spark, d):
    """Symbols exported by flag or by their file's export list."""
    s = _symbols(spark, d, "chunk_id", "symbol_name", "exported", "exports")
    return members.with_export_flag(s).select("chunk_id", "is_exported", (F.col("is_exported") & ~F.coalesce("exported", F.lit(False))).alias("flipped"))


@query
def candidates(spark, d):
    """Symbols that are embedded: of a candidate type and flagged."""
    s = _symbols(spark, d, "chunk_id", "symbol_type", "embedding_candidate")
    return s.where(F.col("embedding_candidate") & F.col("symbol_type").isin(rules.CANDIDATE_TYPES) & ~F.col("symbol_type").isin("import", "export")).select("chunk_id", "symbol_type")


# ---------------------------------------------------------------- aggregates
@query
def language_breakdown(spark, d):
    """Symbols per repository and language."""
    s = _symbols(spark, d, "repo", "chunk_id", "language")
    return s.groupBy("repo", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n_symbols"))


@query
def languages_sorted(spark, d):
    """The languages of each repository."""
    return table(spark, d, "code_symbol", "repo", "language").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query
def type_pivot(spark, d):
    """Symbols per type group of each repository."""
    s = _symbols(spark, d, "repo", "chunk_id", "symbol_type")
    of = lambda *t: F.count_if(F.col("symbol_type").isin(*t))
    return s.groupBy("repo").agg(of("function", "async_function", "arrow_function").alias("functions"), of("class", "interface").alias("classes"), of("method").alias("methods"), of("struct").alias("structs"), of("enum").alias("enums"), of("trait").alias("traits"), of("chunk").alias("chunks"))


@query
def type_counts(spark, d):
    """Symbols of each type in each repository."""
    return _symbols(spark, d, "repo", "chunk_id", "symbol_type").groupBy("repo", "symbol_type").agg(F.count("*").alias("n_symbols"))


@query
def cleaning_counts(spark, d):
    """What is found in each repository, what is left out of it as import or export, what only the export list exports, what stays."""
    s = members.with_export_flag(_symbols(spark, d, "repo", "chunk_id", "symbol_name", "symbol_type", "exported", "exports"))
    of = lambda t: F.count_if(F.col("symbol_type") == t)
    counts = s.groupBy("repo").agg(F.count("*").alias("raw"), of("import").alias("imports_removed"), of("export").alias("exports_removed"), F.count_if(F.col("is_exported") & ~F.coalesce("exported", F.lit(False))).alias("flipped"))
    return counts.withColumn("total_symbols", F.col("raw") - F.col("imports_removed") - F.col("exports_removed"))


@query
def registry_counts(spark, d):
    """Counts of symbols, files and indexed symbols of every repository that has any of them."""
    parts = [
        table(spark, d, name, F.col("repo").alias("name"), F.lit(to).alias("kind"), F.col(id_).alias("id"))
        for name, id_, to in (("code_symbol", "chunk_id", "symbol_count"), ("source_file", "file", "file_count"), ("indexed_dataset", "symbol_id", "embedding_count"))
    ]
    once = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("id is not null").distinct()
    return once.groupBy("name").agg(*[F.count_if(F.col("kind") == c).alias(c) for c in ("symbol_count", "file_count", "embedding_count")])


@query
def symbol_stats(spark, d):
    """Totals per repository: symbols, parents, candidates, exports, chunks."""
    s = _symbols(spark, d, "repo", "chunk_id", "symbol_name", "symbol_type", "parent_symbol", "embedding_candidate", "exported", "exports")
    x = members.with_export_flag(s)
    return x.groupBy("repo").agg(
        F.count("*").alias("total_symbols"), F.count("parent_symbol").alias("with_parent"), F.count_if("embedding_candidate").alias("candidates"), F.count_if("is_exported").alias("exported"),
        F.count_if(F.col("is_exported") & ~F.coalesce("exported", F.lit(False))).alias("flipped"), F.max((F.col("symbol_type") == "chunk").cast("int")).alias("large_chunked"),
    )


@query
def parse_failures(spark, d):
    """Files with a failed parse per repository and language."""
    s = table(spark, d, "code_symbol", "repo", "file", "language", F.col("metadata.ast_parse_failure").alias("failed"))
    per_file = s.groupBy("repo", "file", "language").agg(F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"))
    return per_file.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count_if("failed").alias("n_failed"))


# ---------------------------------------------------------------- registry and index
_REGISTRY = ("name", "url", "status", "indexed_at", "symbol_count", "file_count", "embedding_count", "index_version")


@query
def repo_name_from_url(spark, d):
    """The repository's name in each address."""
    return table(spark, d, "registry", "url").distinct().select("url", ft.repo_name(F.col("url")).alias("repo_name"))


@query
def url_normalise(spark, d):
    """Addresses in their comparable form, and how many spellings each has."""
    n = table(spark, d, "registry", "url").where("url is not null").distinct().select(ft.normal_url(F.col("url")).alias("normal_url"))
    return n.groupBy("normal_url").agg(F.count("*").alias("n_spellings"))


@query
def registry_current(spark, d):
    """The current row of each repository."""
    return registry.current(table(spark, d, "registry", *_REGISTRY))


@query
def registry_upsert(spark, d):
    """The state after the late rows are merged into the earlier ones, by key."""
    history = table(spark, d, "registry", *_REGISTRY)
    early = registry.current(history.where("indexed_at is null or indexed_at < timestamp'2025-08-01'"))
    late = registry.current(history.where("indexed_at >= timestamp'2025-08-01'"))
    return registry.upsert(early, late, "name")


@query
def registry_change(spark, d):
    """Current rows with the symbol counts that the symbols themselves give."""
    counts = table(spark, d, "code_symbol", F.col("repo").alias("name"), "chunk_id").distinct().groupBy("name").agg(F.count("*").alias("symbol_count"))
    return registry.change(registry.current(table(spark, d, "registry", *_REGISTRY)), counts)


@query
def registry_register(spark, d):
    """Repositories that have files are registered anew with zero counts; others keep their row."""
    names = table(spark, d, "source_file", F.col("repo").alias("name")).distinct()
    base = registry.current(table(spark, d, "registry", *_REGISTRY))
    zero = {c: F.lit(0) for c in ("symbol_count", "file_count", "embedding_count")}
    return registry.register(base, names, status=F.lit("indexing"), **zero)


@query
def registry_semi(spark, d):
    """Files per repository that is registered as indexed."""
    names = table(spark, d, "registry", "name", "status").where("status = 'indexed'").select(F.col("name").alias("repo")).distinct()
    return table(spark, d, "source_file", "repo", "file").distinct().join(names, "repo", "left_semi").groupBy("repo").agg(F.count("*").alias("n_files"))


@query
def registry_anti(spark, d):
    """Registered repositories of which nothing is indexed."""
    indexed = table(spark, d, "indexed_dataset", F.col("repo").alias("name")).distinct()
    return table(spark, d, "registry", "name").distinct().join(indexed, "name", "left_anti")


@query
def delete_cascade(spark, d):
    """Symbols and indexed rows per repository left after those without an address are deleted."""
    gone = registry.current(table(spark, d, "registry", *_REGISTRY)).where("url is null").select("name")
    kept = registry.without(table(spark, d, "code_symbol", "repo", "chunk_id").distinct(), gone, "repo").groupBy("repo").agg(F.count("*").alias("n_symbols"))
    index = registry.without(table(spark, d, "indexed_dataset", "repo", "symbol_id").distinct(), gone, "repo").groupBy("repo").agg(F.count("*").alias("n_indexed"))
    return kept.join(index, "repo", "left").select("repo", "n_symbols", F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))


@query
def index_upsert(spark, d):
    """One indexed row per symbol: the first chunk's text in place of what was indexed."""
    names = ("symbol_id", "repo", "symbol_name", "symbol_type", "file", "language", "retrieval_text")
    base = table(spark, d, "indexed_dataset", *names).distinct()
    once = base.groupBy("symbol_id").agg(F.max_by(F.struct(*names[1:]), F.coalesce("retrieval_text", F.lit(""))).alias("r")).select("symbol_id", "r.*")
    fresh = table(spark, d, "code_symbol", *names, "start_line").where("embedding_candidate and retrieval_text is not null").groupBy("symbol_id").agg(F.min_by(F.struct(*names[1:]), F.struct("start_line", "retrieval_text")).alias("r")).select("symbol_id", "r.*")
    return registry.upsert(once, fresh, "symbol_id").select("symbol_id", "repo", "symbol_name", "symbol_type", F.md5(F.coalesce("retrieval_text", F.lit(""))).alias("text_md5"))


# ---------------------------------------------------------------- search
def _search(spark, d, metric, k=5):
    e = table(spark, d, "embeddings", "vec_id", "embedding").distinct()
    return search.top_k(e.where("vec_id % 50 = 0"), e, k, "vec_id", "embedding", metric)


@query
def cosine_topk(spark, d):
    """The 5 most similar vectors for each query vector."""
    return _search(spark, d, "cosine").select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("cosine"), "rank")


@query
def cosine_topk_filtered(spark, d):
    """The same under a filter: only vectors with an odd label are searched, for queries of every label."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").distinct()
    found = search.top_k(e.where("vec_id % 50 = 0"), e.where("label % 2 = 1"), 5, "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("cosine"), "rank")


@query
def cosine_topk_by_label(spark, d):
    """The 5 most similar vectors of the query's own label for each query vector that has one."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").distinct()
    found = search.top_k(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "embedding", within="label")
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("cosine"), "rank")


@query
def l2_topk(spark, d):
    """The 5 nearest vectors by squared distance."""
    return _search(spark, d, "l2").select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("distance"), "rank")


def _sections(spark, d):
    s = _symbols(spark, d, "repo", "chunk_id", "symbol_type", "symbol_name", "file", "language", "retrieval_text").where("retrieval_text is not null")
    rank = F.row_number().over(W.partitionBy("repo", "file").orderBy("chunk_id"))
    ranked = s.withColumn("query_id", F.concat_ws("/", "repo", "file")).withColumn("rank", rank)
    hit = {c: F.col(c) for c in ("symbol_type", "symbol_name", "file", "language", "retrieval_text")}
    return ranked.select("query_id", "chunk_id", "rank", search.section(F.col("rank"), hit).alias("section"))


@query
def context_budget(spark, d):
    """Which of each file's symbols fit into one context."""
    return search.within_budget(_sections(spark, d)).select("query_id", "chunk_id", "rank", "used")


@query
def context_string(spark, d):
    """One context per file, as its length and md5."""
    c = search.contexts(_sections(spark, d))
    return c.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


@query
def prompt_build(spark, d):
    """One prompt per file that has symbols, as its md5."""
    c = search.contexts(_sections(spark, d))
    return c.select("query_id", F.md5(search.prompt(F.col("context"), F.concat(F.lit("What does "), F.col("query_id"), F.lit(" do?")))).alias("prompt_md5"))


def queries() -> dict[str, Query]:
    """All queries of the core by name."""
    return dict(_ALL)
