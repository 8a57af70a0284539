"""Views over the driver's tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sections

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(text: str) -> str:
    """A string as SQL."""
    return "'" + text.replace("'", "''") + "'"


def u16_sql(c: str) -> str:
    """The UTF-16 units of a text, in SQL."""
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


#: Markup that documents lack; each document gets one at its end, by its id.
SNIPPETS = [
    "#Heading\n##  Sub\n-item one\n*item two\n1.5 units\n2)second\n\n\n\nend of a hyphen-\nated word",
    "A table:\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\nand `code` with $x_1$ and \\(y^2\\) here.",
    "```python\nprint('x')\n```\n\n$$\nE = mc^2\n$$\n\nFigure 1: a caption\n![alt \"q\"](img/a.png \"Title & more\")",
    "<table><tr><td>open cell\n\n# After a table\n> quoted text\n\\begin{align}\na &= b\n\\end{align}",
    "中文 测试 ，好 （ 试 ）完 。 mixed    spaces\tand tabs\r\nwindows line\rold line  ",
    "&lt;table&gt;&lt;tr&gt;&lt;td class=&quot;x&quot;&gt;1&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt; and $a=b$$c=d$ & <b>bold</b> \"quoted\"",
    "(a) left panel Figure 2: both panels\nTable 3: numbers\n(b) right\n<img src=\"x.png\">\n\nends without a stop and\n\n![](b.png)\n\ncontinues after the figure",
]


def markup_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", F.lit("\n\n"), snippet).alias("text"))


MARKUP_SQL = f"(SELECT doc_id, text || chr(10) || chr(10) || [{', '.join(map(lit, SNIPPETS))}][doc_id % {len(SNIPPETS)} + 1] AS text FROM documents)"


def paper_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.paper_view(table(spark, sf_dir, "documents"))


PAPER_SQL = """(SELECT doc_id, '# ' || source || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda line, k:
  CASE WHEN (k - 1) % 4 <> 0 THEN line WHEN (doc_id + k - 1) % 7 = 0 THEN '## References' || chr(10) || line
       ELSE '## Section ' || (k - 1)::VARCHAR || chr(10) || line END), chr(10) || chr(10)) AS text FROM documents)"""


def digest(text: Column, name: str = "digest") -> Column:
    return F.md5(text).alias(name)
