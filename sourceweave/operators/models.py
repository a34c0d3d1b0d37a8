"""Data models of five ORM dialects, their fields and foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import rules as R
from sourceweave.functions.lines import contains_any, extract, first_of, lines_of, non_empty, strip


def orm_dialect(content: Column) -> Column:
    low = F.lower(content)
    return (
        F.when(low.contains("sqlalchemy") | content.contains("Column("), "sqlalchemy")
        .when(low.contains("prisma") | content.rlike(r"model\s+\w+\s*\{"), "prisma")
        .when(content.contains("@Entity") | low.contains("typeorm"), "typeorm")
        .when(contains_any(content, ["models.Model", "from django.db"]), "django")
        .when(low.contains("mongoose") | content.contains("new Schema("), "mongoose")
        .otherwise("unknown")
    )


def _class_body(rest: Column) -> Column:
    """Lines after a class line up to the first one indented less than the body.

    The first non-blank, non-comment line fixes the body indent.
    """
    code = F.transform(
        rest,
        lambda x: F.when((strip(x) != "") & ~strip(x).startswith("#"), F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))),
    )
    return F.element_at(
        F.transform(
            F.array(F.struct(code.alias("code"), rest.alias("rest"))),
            lambda v: F.element_at(
                F.transform(
                    F.array(first_of(F.filter(v["code"], lambda c: c.isNotNull()))),
                    lambda level: F.array_join(
                        F.slice(
                            v["rest"],
                            F.lit(1),
                            F.coalesce(
                                F.nullif(F.array_position(F.transform(v["code"], lambda c: F.coalesce(c < level, F.lit(False))), True), F.lit(0)) - 1,
                                F.size(v["rest"]),
                            ).cast("int"),
                        ),
                        "\n",
                    ),
                ),
                1,
            ),
        ),
        1,
    )


def _pairs(text: Column, pattern: str, make) -> Column:
    """``make(index, *groups)`` for every match of ``pattern``; groups come as arrays of equal length."""
    n_groups = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
    groups = [F.regexp_extract_all(text, F.lit(pattern), g) for g in range(1, n_groups + 1)]
    return F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda z: make(*[z[f"g{i}"] for i in range(n_groups)]))


def _field(name, type_, nullable, primary, default=None, fk=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        type_.alias("type"),
        nullable.alias("nullable"),
        primary.alias("primary_key"),
        (null if default is None else default).alias("default_value"),
        (null if fk is None else fk).alias("foreign_key"),
    )


def _sqlalchemy_fields(body: Column) -> Column:
    def make(name, spec):
        primary = spec.contains("primary_key=True")
        nullable = F.when(spec.contains("nullable=True"), True).when(spec.contains("nullable=False"), False).otherwise(~primary)
        return _field(
            name,
            F.coalesce(extract(spec, R.SQLALCHEMY_TYPE), F.lit("unknown")),
            nullable,
            primary,
            strip(extract(spec, R.SQLALCHEMY_DEFAULT)),
            extract(spec, R.SQLALCHEMY_FK),
        )

    return _pairs(body, R.SQLALCHEMY_COLUMN, make)


def _django_fields(body: Column) -> Column:
    return _pairs(
        body,
        R.DJANGO_FIELD,
        lambda name, kind, spec: _field(name, kind, contains_any(spec, ["null=True", "blank=True"]), spec.contains("primary_key=True")),
    )


def _prisma_fields(body: Column) -> Column:
    rows = F.filter(
        F.transform(F.split(body, "\n", -1), lambda x: strip(x)),
        lambda x: x.rlike(R.PRISMA_FIELD) & ~x.startswith("//") & ~x.startswith("@@"),
    )
    return F.transform(
        rows,
        lambda x: _field(F.regexp_extract(x, R.PRISMA_FIELD, 1), F.regexp_extract(x, R.PRISMA_FIELD, 2), x.contains("?"), x.contains("@id")),
    )


def _typeorm_fields(body: Column) -> Column:
    no = F.lit(False)
    keys = _pairs(body, R.TYPEORM_PRIMARY, lambda spec, name: _field(name, F.lit("number"), no, F.lit(True)))
    columns = _pairs(
        body,
        R.TYPEORM_COLUMN,
        lambda spec, name, kind: _field(name, F.coalesce(non_empty(kind), F.lit("string")), spec.contains("nullable: true"), no),
    )
    return F.concat(keys, columns)


def _mongoose_fields(content: Column, name: Column) -> Column:
    head, tail = R.MONGOOSE_SCHEMA.split("{name}")
    schema = F.coalesce(first_of(F.regexp_extract_all(content, F.concat(F.lit(head), name, F.lit(tail)), 1)), F.lit(""))
    return _pairs(schema, R.MONGOOSE_FIELD, lambda f, kind: _field(f, kind, F.lit(True), f == "_id"))


def extract_models(files: DataFrame, dialect: str | None = None) -> DataFrame:
    """One row per model with its fields as an array of structs.

    The dialect is detected per file unless one is named. A class or entity
    head is looked for line by line; its body is read from the line array of
    the same row.
    """
    detected = orm_dialect(F.col("content")) if dialect is None else F.lit(dialect)
    src = files.select("project_id", "path", detected.alias("dialect"), "content", lines_of(F.col("content")).alias("lines"))
    d, line, lines = F.col("dialect"), F.col("line"), F.col("lines")

    def head_of(x: Column) -> Column:
        return (
            F.when(d == "sqlalchemy", extract(x, R.SQLALCHEMY_CLASS))
            .when(d == "django", extract(x, R.DJANGO_CLASS))
            .when(d == "mongoose", extract(x, R.MONGOOSE_MODEL))
            .when(d == "prisma", extract(x, r"model\s+(\w+)\s*\{"))
            .when(d == "typeorm", F.when(x.contains("@Entity("), "?"))
        )

    # only lines with a head become rows: each carries the text and the lines of its file
    found = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line"), head_of(x).alias("head"))), lambda h: h["head"].isNotNull()
    )
    src = src.where((d != "unknown") & ((d != "typeorm") | F.col("content").contains("@Entity(")))
    rows = src.select("project_id", "path", "dialect", "content", "lines", F.explode_outer(found).alias("h")).where("h is not null")
    rows = rows.select("project_id", "path", "dialect", "content", "lines", "h.pos", "h.line", "h.head")
    rest = F.slice(lines, F.col("pos") + 2, F.size(lines))
    here = F.array_join(F.slice(lines, F.col("pos") + 1, F.size(lines)), "\n")
    heads = (
        rows.select(
            "project_id",
            "path",
            "dialect",
            "content",
            (F.col("pos") + 1).alias("line_no"),
            "line",
            "head",
            F.when(d.isin("sqlalchemy", "django"), F.concat_ws("\n", line, _class_body(rest)))
            .when(d == "typeorm", F.regexp_extract(here, R.TYPEORM_BODY, 1))
            .when(d == "prisma", F.regexp_extract(here, R.PRISMA_MODEL, 2))
            .alias("body"),
            F.when(d == "typeorm", F.regexp_extract(here, R.TYPEORM_ENTITY, 2))
            .when(d == "prisma", F.regexp_extract(here, R.PRISMA_MODEL, 1))
            .otherwise(F.col("head"))
            .alias("name"),
            F.when(d == "typeorm", F.regexp_extract(here, R.TYPEORM_ENTITY, 1)).alias("entity_table"),
        )
        .where((F.col("name") != "") & ((d != "prisma") | (F.col("name") == F.col("head"))))
    )
    body, name = F.col("body"), F.col("name")
    table = (
        F.when(d == "sqlalchemy", extract(body, R.SQLALCHEMY_TABLE))
        .when(d == "typeorm", non_empty(F.col("entity_table")))
        .when(d == "mongoose", F.regexp_extract("line", R.MONGOOSE_MODEL, 2))
    )
    fields = (
        F.when(d == "sqlalchemy", _sqlalchemy_fields(body))
        .when(d == "django", _django_fields(body))
        .when(d == "prisma", _prisma_fields(body))
        .when(d == "typeorm", _typeorm_fields(body))
        .otherwise(_mongoose_fields(F.col("content"), name))
    )
    return heads.select(
        "project_id",
        "path",
        "line_no",
        "name",
        F.coalesce(table, F.lower(name)).alias("table_name"),
        d.alias("model_type"),
        fields.alias("fields"),
    )


def model_fields(models: DataFrame) -> DataFrame:
    rows = models.select("project_id", "path", F.col("name").alias("model"), "line_no", F.posexplode_outer("fields").alias("pos", "f"))
    rows = rows.where("pos is not null")
    return rows.select("project_id", "path", "model", "line_no", (F.col("pos") + 1).alias("ordinal"), "f.*")


def model_summary(models: DataFrame) -> DataFrame:
    """Models and fields per project and dialect; models without fields count too."""
    return models.groupBy("project_id", "model_type").agg(
        F.count("*").alias("models"), F.sum(F.size("fields")).alias("fields"), F.count_if(F.size("fields") == 0).alias("without_fields")
    )


def foreign_key_edges(fields: DataFrame) -> DataFrame:
    """``table.column`` references as edges from a model to a table."""
    target = F.split("foreign_key", r"\.")
    return fields.where(F.col("foreign_key").isNotNull()).select(
        "project_id",
        F.col("model").alias("source_model"),
        F.col("name").alias("source_field"),
        target[0].alias("target_table"),
        F.get(target, F.lit(1)).alias("target_column"),
    )
