"""Question types, context packing, prompts, citations and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import prompts as P
from sourceweave.functions.lines import contains_any, non_empty, strip


def _hits(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def question_type(text: Column) -> Column:
    low = F.lower(text)
    impl, plan = _hits(low, P.IMPLEMENTATION_KEYWORDS), _hits(low, P.PLANNING_KEYWORDS)
    return F.when(impl > plan, "implementation").when(plan > impl, "planning").otherwise("hybrid")


def context_pack(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered source blocks per question; a fixed text when there are none.

    ``hits(query_id, rank, file, line, content)`` holds the top-k only, so each
    packed group has at most ``k`` rows.
    """
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] File: "), F.coalesce("file", F.lit("unknown")))
    line = F.when(F.col("line").isNotNull(), F.concat(F.lit(", Line: "), F.col("line").cast("string"))).otherwise("")
    block = F.concat(head, line, F.lit("\n```\n"), F.col("content"), F.lit("\n```\n"))
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("text"))))
    packed = hits.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("context"), F.count("*").alias("sources")
    )
    return questions.join(packed, "query_id", "left").select(
        "query_id",
        "text",
        F.coalesce("context", F.lit(P.NO_CONTEXT)).alias("context"),
        F.coalesce("sources", F.lit(0)).alias("sources"),
    )


def project_header(projects: DataFrame) -> DataFrame:
    """Short header of ``projects(project_id, name, source_type, file_count, line_count, status, branch)``."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value.cast("string"))

    text = F.concat_ws(
        "\n",
        F.lit("=== Project Information ==="),
        line("Name", F.col("name")),
        line("Source Type", F.coalesce("source_type", F.lit("unknown"))),
        line("File Count", F.col("file_count")),
        line("Line Count", F.col("line_count")),
        line("Status", F.coalesce("status", F.lit("unknown"))),
        line("Branch", non_empty(F.col("branch"))),
        F.lit("=" * 30),
    )
    return projects.select("project_id", text.alias("header"))


def _cut(text: Column, limit: int | None) -> Column:
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(P.TRUNCATED))).otherwise(text)


def full_header(projects: DataFrame, readme_limit: int | None = None) -> DataFrame:
    """Rich header with tech stack (``array<string>``), summary and README, whole or cut at ``readme_limit``."""
    rule = "=" * 40
    summary, readme = non_empty(F.col("summary")), non_empty(F.col("readme"))
    text = F.concat_ws(
        "\n",
        F.lit("=== 项目信息 ==="),
        F.concat(F.lit("项目名称: "), "name"),
        F.concat(F.lit("来源类型: "), non_empty(F.col("source_type"))),
        F.concat(F.lit("分支: "), non_empty(F.col("branch"))),
        F.concat(F.lit("文件数: "), F.col("file_count").cast("string")),
        F.concat(F.lit("代码行数: "), F.col("line_count").cast("string")),
        F.when(F.size("tech_stack") > 0, F.concat(F.lit("技术栈: "), F.array_join("tech_stack", ", "))),
        F.lit(rule),
        F.concat(F.lit("\n=== 项目摘要 ===\n"), summary, F.lit("\n" + rule)),
        F.concat(F.lit("\n=== README ===\n"), _cut(readme, readme_limit), F.lit("\n" + rule)),
    )
    return projects.select("*", text.alias("header"))


def smart_context(
    projects: DataFrame,
    mode: str = "default",
    readme_limit: int | None = None,
    code_limit: int | None = None,
    code_results: int | None = None,
) -> DataFrame:
    """Sections the mode needs, after the rich header.

    ``projects`` adds to the header columns ``structure`` (text) and ``code``
    (``array<struct<file,content>>`` in rank order). READMEs, code and the number
    of code results are cut only where a limit is given.
    """
    needs = P.NEEDS_BY_MODE.get(mode, P.NEEDS_BY_MODE["default"])

    def section(name: str, body: Column) -> Column:
        return F.concat(F.lit(P.SECTION_TITLES[name] + "\n"), body, F.lit("\n")) if name in needs else F.lit(None).cast("string")

    code = F.array_join(
        F.transform(
            F.col("code") if code_results is None else F.slice("code", 1, code_results),
            lambda c, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] "), c["file"], F.lit("\n```\n"), c["content"] if code_limit is None else F.substring(c["content"], 1, code_limit), F.lit("\n```\n")
            ),
        ),
        "\n",
    )
    parts = F.concat_ws(
        "\n",
        section("readme", _cut(non_empty(F.col("readme")), readme_limit)),
        section("summary", non_empty(F.col("summary"))),
        section("structure", non_empty(F.col("structure"))),
        section("tech_stack", F.when(F.size("tech_stack") > 0, F.array_join("tech_stack", ", "))),
        section("code", F.when(F.size("code") > 0, code)),
    )
    text = F.when(parts == "", F.col("header")).otherwise(F.concat("header", F.lit("\n\n"), parts))
    return full_header(projects, readme_limit).select("project_id", text.alias("context"))


def prompt_rows(packed: DataFrame, chat_mode: str = "project") -> DataFrame:
    """Prompt text per question; the template follows the question type.

    ``packed(query_id, text, context[, header])``.
    """
    kind = question_type(F.col("text"))
    context = F.col("context")
    if "header" in packed.columns:
        context = F.concat_ws("\n\n", non_empty(F.col("header")), "context")
    if chat_mode == "freeform":
        context, template = F.lit(""), F.lit(P.PROMPTS["freeform"])
    else:
        template = F.lit(P.PROMPTS["hybrid"])
        for name in ("implementation", "planning"):
            template = F.when(kind == name, P.PROMPTS[name]).otherwise(template)
    # cut the template once, so braces inside the context stay as they are
    pieces = F.split(F.replace(template, F.lit("{question}"), F.lit("{context}")), r"\{context\}")
    prompt = (
        F.concat(pieces[0], F.col("text"), pieces[1])
        if chat_mode == "freeform"
        else F.concat(pieces[0], context, pieces[1], F.col("text"), pieces[2])
    )
    return packed.select("query_id", (F.lit("freeform") if chat_mode == "freeform" else kind).alias("qa_type"), prompt.alias("prompt"))


def citations_of(text: Column) -> Column:
    """``array<struct<file,line,end_line>>``: links first, then bare references not yet listed."""

    def found(pattern: str) -> Column:
        files, first, last = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (1, 2, 3))
        return F.transform(
            F.arrays_zip(files.alias("f"), first.alias("l"), last.alias("e")),
            lambda z: F.struct(z["f"].alias("file"), z["l"].cast("int").alias("line"), non_empty(z["e"]).cast("int").alias("end_line")),
        )

    links = found(P.CITATION_LINK)
    return F.concat(links, F.array_except(found(P.CITATION_BARE), links))


def extract_citations(answers: DataFrame) -> DataFrame:
    rows = answers.select("answer_id", F.posexplode_outer(citations_of(F.col("text"))).alias("pos", "c")).where("pos is not null")
    return rows.select("answer_id", (F.col("pos") + 1).alias("ordinal"), "c.*")


def format_citation(file: Column, line: Column, end_line: Column) -> Column:
    span = F.when(end_line.isNotNull() & (end_line != 0) & (end_line != line), F.concat(F.lit("-"), end_line.cast("string"))).otherwise("")
    return F.concat(
        F.lit("["), file, F.lit(":"), line.cast("string"), span, F.lit("]("), file, F.lit("#L"), line.cast("string"), F.lit(")")
    )


def add_sources(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Append the source list to answers; ``hits(answer_id, rank, file, line, end_line)`` are top-k rows."""
    item = F.concat(F.lit("- "), format_citation(F.col("file"), F.col("line"), F.col("end_line")), F.lit("\n"))
    items = F.array_sort(F.collect_list(F.struct("rank", item.alias("text"))))
    listed = hits.groupBy("answer_id").agg(F.array_join(F.transform(items, lambda b: b["text"]), "").alias("items"))
    joined = answers.join(listed, "answer_id", "left")
    full = F.concat("text", F.lit(P.SOURCES_TITLE), "items")
    return joined.select("answer_id", F.coalesce(full, F.col("text")).alias("text"))


def extract_code_blocks(answers: DataFrame) -> DataFrame:
    """Fenced blocks with language, code and character offsets (0-based, end exclusive)."""
    text = F.col("text")
    whole, lang, code = (F.regexp_extract_all(text, F.lit(P.CODE_BLOCK), g) for g in (0, 1, 2))
    blocks = F.arrays_zip(whole.alias("w"), lang.alias("l"), code.alias("c"))
    zero = F.struct(
        F.array().cast("array<struct<language:string,code:string,start:int,end:int>>").alias("done"), F.lit(0).alias("pos")
    )

    def step(s: Column, b: Column) -> Column:
        # the next occurrence of the matched text is the match itself
        start = F.position(b["w"], text, s["pos"] + 1) - 1
        end = start + F.length(b["w"])
        row = F.struct(
            F.coalesce(non_empty(b["l"]), F.lit("unknown")).alias("language"), strip(b["c"]).alias("code"), start.alias("start"), end.alias("end")
        )
        return F.struct(F.array_append(s["done"], row).alias("done"), end.alias("pos"))

    found = F.aggregate(blocks, zero, step, lambda s: s["done"])
    rows = answers.select("answer_id", F.posexplode_outer(found).alias("pos", "b")).where("pos is not null")
    return rows.select("answer_id", (F.col("pos") + 1).alias("ordinal"), "b.*")


def _scores(answers: DataFrame, hits: DataFrame) -> DataFrame:
    per = hits.groupBy("answer_id").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))
    return answers.join(per, "answer_id", "left")


def answer_confidence(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """0 without sources, else weighted mean score plus bonuses, at most 1."""
    cited = F.size(citations_of(F.col("text"))) > 0
    value = F.col("avg_score") * 0.7 + F.when(cited, 0.2).otherwise(0.0) + F.when(F.col("n") >= 3, 0.1).otherwise(0.0)
    score = F.when(F.col("n").isNull(), 0.0).otherwise(F.least(value, F.lit(1.0)))
    return _scores(answers, hits).select("answer_id", score.alias("confidence"))


def smart_confidence(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """0.3 without sources, else weighted mean score plus reference and count bonuses, at most 1."""
    refs = contains_any(F.col("text"), ["文件", "```"]) | F.lower("text").contains("file")
    bonus = F.when(refs, 0.2).otherwise(0.0) + F.when(F.col("n") >= 3, 0.1).otherwise(0.0) + F.when(F.col("n") >= 5, 0.1).otherwise(0.0)
    score = F.when(F.col("n").isNull(), 0.3).otherwise(F.least(F.col("avg_score") * 0.6 + bonus, F.lit(1.0)))
    return _scores(answers, hits).select("answer_id", score.alias("confidence"))


def json_from_text(text: Column) -> Column:
    """JSON object inside a reply: fences dropped, first ``{`` to last ``}``; null when it does not parse."""
    bare = strip(text)
    lines = F.split(bare, "\n", -1)
    fenced = bare.startswith("```")
    inner = (
        F.when(fenced & (F.size(lines) > 2), F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n"))
        .when(fenced & (F.size(lines) == 2), lines[1])
        .otherwise(bare)
    )
    body = non_empty(F.regexp_extract(inner, r"(?s)\{.*\}", 0))
    return F.when(F.try_parse_json(body).isNotNull(), body)
