"""Inputs the registered queries derive from the given tables.

The SQL is in the part that Spark and DuckDB share, so one text serves the query and its check.
``{table}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DOCS = """
SELECT CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) AS source_no,
       doc_id AS doc_ord, concat(text, chr(10)) AS text
FROM {documents}
"""

FORUM = """
SELECT doc_id,
       CASE WHEN doc_id % 50 = 0 THEN NULL
            WHEN doc_id % 50 = 1 THEN 'None'
            WHEN doc_id % 50 = 2 THEN ' 　 '
            WHEN doc_id % 7 = 3 THEN replace(text, chr(10), concat(chr(13), chr(10)))
            WHEN doc_id % 7 = 4 THEN replace(text, chr(10), concat(chr(10), chr(10), '  ', chr(10)))
            WHEN doc_id % 7 = 5 THEN concat('　', text, '　')
            WHEN doc_id % 7 = 6 THEN replace(text, chr(10), chr(13))
            ELSE text END AS body,
       CASE WHEN doc_id % 5 = 0 THEN '其他' ELSE '文本' END AS block_type
FROM {documents}
"""

# The next turn comes by an equi join on (conversation, turn): a very long conversation
# spreads over tasks, where a window over it would not.
QA = """
SELECT u.conv_id, u.turn,
       CASE WHEN u.conv_id % 10 = 0 THEN NULL WHEN u.conv_id % 10 = 1 THEN '　 '
            ELSE concat('　', u.text, ' ') END AS q,
       CASE WHEN u.conv_id % 10 = 2 THEN '' ELSE r.text END AS a
FROM {conversations} u
JOIN {conversations} r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
WHERE u.role = 'user' AND r.role = 'assistant'
"""

NEWS = """
SELECT doc_id,
       CASE WHEN doc_id % 20 = 0 THEN NULL WHEN doc_id % 20 = 1 THEN ''
            WHEN doc_id % 20 = 2 THEN '  ' ELSE split_part(text, chr(10), 1) END AS title,
       substr(text, length(split_part(text, chr(10), 1)) + 2) AS body
FROM {documents}
"""

CATALOG = """
SELECT page_id,
       concat(CASE WHEN page_id % 4 = 0 THEN 'qa/site/' WHEN page_id % 4 = 1 THEN 'qa/assistant/'
                   WHEN page_id % 4 = 2 THEN 'forum/blocks/' ELSE 'misc/' END,
              lpad(CAST(page_id AS STRING), 6, '0'),
              CASE WHEN page_id % 4 = 2 THEN '.parquet' WHEN page_id % 9 = 0 THEN '.md'
                   ELSE '.jsonl.gz' END) AS path
FROM {pages}
"""

LOG = """
SELECT event_id AS step,
       concat('2024-01-01 00:00:00,000 trainer INFO step ', CAST(event_id AS STRING), ': loss ', CAST(value AS STRING),
              ', grad_norm 0.500000, lr 6.00e-04, dt ', CAST(40000 + event_id % 100 AS STRING),
              '.00ms, tok/sec 11500.00') AS line
FROM {events}
"""

VAL_LOG = """
SELECT event_id AS step,
       CASE WHEN event_id % 100 = 0
            THEN concat('step ', CAST(event_id AS STRING), ': validation loss ', CAST(value AS STRING))
            ELSE concat('step ', CAST(event_id AS STRING), ': loss ', CAST(value AS STRING)) END AS line
FROM {events}
"""

CURSOR = """
SELECT event_id AS step,
       CAST(floor(event_id * 128 / 244) AS BIGINT) AS data_shard,
       ((event_id * 128) % 244) * 4096 AS data_position
FROM {events}
"""

CHECKPOINT_PATHS = """
SELECT CASE WHEN event_id % 7 = 3 THEN concat('checkpoints/final-', CAST(event_id AS STRING))
            ELSE concat('checkpoints/checkpoint_step_', CAST(event_id AS STRING), '/') END AS path
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{name: f"parquet.`{sf_dir}/{name}.parquet`" for name in TABLES}))


def for_check(sql: str) -> str:
    """The same text over the views of the check database."""
    return sql.format(**{name: name for name in TABLES})
