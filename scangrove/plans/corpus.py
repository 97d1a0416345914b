"""Tables derived from the given ones, so that every operator has something to work on.

All derivations are arithmetic on the ids, so the same tables can be written
down in SQL.  They add to the given texts and never leave any out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CATEGORIES, MANIFESTS, SEVERITIES
from ..functions.text import description_hash
from ..session import spread
from ..sources.tree import read_text, source_files
from .snippets import CONTENTS, LINES

SUFFIXES = [".py", ".js", ".ts", ".java", ".go", ".sh", ".bash", ".jsx", ".md", ".m"]
MANIFEST_EVERY = 97
REPO_BLOCK = MANIFEST_EVERY * len(MANIFESTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """The value at ``index`` modulo the length of the list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def repo_of(doc: Column, source: Column) -> Column:
    return F.concat(source, F.lit("-"), F.floor(doc / REPO_BLOCK).cast("string"))


def path_of(doc: Column) -> Column:
    plain = F.concat(F.lit("src/"), (doc % 7).cast("string"), F.lit("/f"), doc.cast("string"), pick(SUFFIXES, doc))
    name = F.when(doc % MANIFEST_EVERY == 0, pick(list(MANIFESTS), F.floor(doc / MANIFEST_EVERY))).otherwise(plain)
    prefix = F.concat(F.when(doc % 59 == 0, ".hidden/").otherwise(""), F.when(doc % 53 == 0, "node_modules/").otherwise(""))
    return F.concat(prefix, name)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a source tree: each text plus one sample line, sometimes a sample content."""
    doc = F.col("doc_id")
    line = F.concat(F.when(doc % 13 == 0, "# ").otherwise(""), pick([x[1] for x in LINES], doc))
    more = F.when(doc % 11 == 0, F.concat(F.lit("\n"), pick([x[1] for x in CONTENTS], doc))).otherwise("")
    raw = F.concat("text", F.lit("\n"), line, more)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(
        repo_of(doc, F.col("source")).alias("repo"), doc.alias("file_ord"), path_of(doc).alias("path"),
        F.octet_length(raw).cast("bigint").alias("size_bytes"), read_text(raw).alias("content"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(tree(spark, sf_dir))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on the documents labelled as of no quality, in turn by rule and by description."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rule = F.when(doc % 3 == 0, "pci-004").when(doc % 3 == 1, "owasp-005")
    return (
        table(spark, sf_dir, "labels").where("quality = 0").join(docs, "doc_id")
        .select(
            F.concat(F.lit("mark-"), doc.cast("string")).alias("id"), repo_of(doc, F.col("source")).alias("repo"),
            path_of(doc).alias("file_path"), rule.alias("rule_id"),
            F.when(doc % 3 == 2, description_hash(note(doc))).alias("description_hash"),
            F.lit("known").alias("reason"),
            F.timestamp_seconds(F.lit(1_700_000_000) + doc).alias("marked_at"), F.lit("user").alias("marked_by"),
        )
    )


def note(doc: Column) -> Column:
    return F.concat(F.lit("Review note "), (doc % 7).cast("string"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model response for every analysed file, in the forms such responses take."""
    doc = F.col("file_ord")
    issue = F.concat(
        F.lit('{"issues":[{"category":"'), pick(CATEGORIES, doc), F.lit('","severity":"'),
        F.when(doc % 6 == 4, "urgent").otherwise(pick(SEVERITIES, doc)), F.lit('","line":'), (doc % 40).cast("string"),
        F.lit(',"description":"'), note(doc), F.lit('","recommendation":"Look at it"}],"summary":"Read."}'),
    )
    sparse = F.concat(F.lit('{"issues":[{"description":"'), note(doc), F.lit('"},{"category":null,"description":"x"}]}'))
    kind = doc % 6
    response = (
        F.when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), issue, F.lit("\n```\nThanks")))
        .when(kind == 2, F.concat(F.lit("Result: "), issue, F.lit(" (end) }")))
        .when(kind == 3, F.concat(F.lit("Sorry. "), F.translate("content", "{}", "()")))
        .when(kind == 5, sparse)
        .otherwise(issue)
    )
    return files(spark, sf_dir).select("repo", "path", "file_ord", response.alias("response"))


def project_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer on each repository, by the number of its files: with issues and score, unreadable, empty, or with an odd score."""
    n = F.col("n")
    full = F.concat(
        F.lit('{"project_level_issues":[{"severity":"high","description":"No tests"},{"category":"bug","severity":"low","file":"README.md","line":3,'
              '"description":"Old","recommendation":"Renew"},{"category":"nothing"}],"overall_assessment":"Fair.","overall_risk_score":'),
        (n % 130).cast("string"), F.lit("}"),
    )
    response = (
        F.when(n % 4 == 0, full).when(n % 4 == 1, "No object here.").when(n % 4 == 2, '{"project_level_issues":[],"overall_assessment":""}')
        .otherwise('Well:\n```json\n{"overall_assessment":"Weak.","overall_risk_score":"high"}\n```')
    )
    return files(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n")).select("repo", response.alias("response"))


def bundle_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers on bundles, a part for each file: an issue of the file and one of no file, and now and then words on the project."""
    doc = F.col("file_ord")
    number = doc.cast("string")
    issues = F.concat(
        F.lit('{"issues":[{"file":"'), "path", F.lit('","category":"'), pick(CATEGORIES, doc), F.lit('","severity":"'),
        F.when(doc % 6 == 4, "urgent").otherwise(pick(SEVERITIES, doc)), F.lit('","line":'), (doc % 40).cast("string"), F.lit(',"description":"'), note(doc),
        F.lit('","recommendation":"Look at it"},{"file":"nowhere.py","description":"lost"}]'),
    )
    project = F.when(doc % 50 == 7, F.concat(
        F.lit(',"project_level_issues":[{"description":"Part '), number, F.lit('"}],"overall_assessment":"Part '), number, F.lit('.","overall_risk_score":'),
        (doc % 130).cast("string"),
    )).otherwise("")
    return files(spark, sf_dir).select("repo", F.concat(issues, project, F.lit("}")).alias("response"))


def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as Python and script modules that import each other; the text follows as comments."""
    doc = F.col("doc_id")
    s = lambda c: c.cast("string")
    group = F.floor(doc / 10)
    script = doc % 10 >= 7
    path = F.when(script, F.concat(F.lit("web/m"), s(doc), F.lit(".js"))).when(
        doc % 10 == 0, F.concat(F.lit("pkg"), s(group), F.lit("/__init__.py")),
    ).otherwise(F.concat(F.lit("pkg"), s(group), F.lit("/m"), s(doc), F.lit(".py")))
    head_py = F.concat(
        F.lit("import os, pkg"), s(group), F.lit("\nfrom .m"), s(group * 10 + 1), F.lit(" import a\nfrom . import m"), s(group * 10 + 2),
        F.lit("\nfrom pkg"), s(group + 1), F.lit(".m"), s(group * 10 + 13), F.lit(" import b\nimport numpy\nfrom ..pkg"), s(group), F.lit(" import c\n"),
    )
    broken = F.when(doc % 10 == 6, "def (:\n").otherwise("")
    head_js = F.concat(
        F.lit("import x from './m"), s(group * 10 + 7), F.lit("'\nconst y = require('../web/m"), s(group * 10 + 8),
        F.lit(".js')\nimport 'react'\nconst z = import('/web/m"), s(group * 10 + 19), F.lit("')\n"),
    )
    body = lambda mark: F.concat(F.lit(mark), F.regexp_replace("text", "\\r\\n|\\r|\\n", "\n" + mark), F.lit("\n"))
    content = F.when(script, F.concat(head_js, body("// "))).otherwise(F.concat(broken, head_py, body("# ")))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        F.lit("mono").alias("repo"), doc.alias("file_ord"), path.alias("path"),
        F.when(script, "JavaScript").otherwise("Python").alias("language"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), content.alias("content"),
    )
