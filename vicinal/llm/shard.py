"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Law: rows. Row number r (rank of the row in (id, size, crc) order) goes to place p(r), where p is a
keyed permutation of 0 .. N-1; shard = p mod n_shards and slot = p div n_shards. So shard sizes
differ by one at most, slots have no gaps, and the place of any row can be computed from its
number, N and the seed alone. Only built-in expressions run on the executors.

A null text has size 1 and the checksum of no bytes; repeated rows take neighbouring numbers, so the multiset
of results is the same whichever comes first; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import shared_dir

ROUNDS = 4
#: A walk leaves the domain's surplus with probability over 1/2 at each step, so 128 steps fail with under 2**-128.
WALKS = 128
#: Rows that a partition numbers at most, about.
ROWS_A_PART = 500_000


def _round_word(seed: int, r: int, half: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(r)), half.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def feistel(x: Column, n: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """One pass over [0, 2**bits), the smallest such domain of at least n places and two bits. rounds is even."""
    bits = max(2, (n - 1).bit_length())
    left_bits, right_bits = bits // 2, bits - bits // 2
    left, right = F.shiftright(x, right_bits), x.bitwiseAND(F.lit((1 << right_bits) - 1))
    for r in range(rounds):
        left, right = right, left.bitwiseXOR(_round_word(seed, r, right).bitwiseAND(F.lit((1 << left_bits) - 1)))
        left_bits, right_bits = right_bits, left_bits
    return F.shiftleft(left, right_bits).bitwiseOR(right)


def permuted(df: DataFrame, x: str, n: int, out_col: str, seed: int = 0) -> DataFrame:
    """Column out_col: a permutation of 0 .. n-1, found by walking along the Feistel cycle until it is back below n."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        feistel(F.col(x), n, seed),
        lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)),
    )
    stuck = F.raise_error(F.lit("cycle walking did not end")).cast("bigint")
    return df.withColumn(out_col, walk).withColumn(out_col, F.when(F.col(out_col) < n, F.col(out_col)).otherwise(stuck))


def numbered(df: DataFrame, order: list[str], out_col: str) -> DataFrame:
    """df with a gapless global row number from 0 in `order`, without a single-task sort.

    Ranges are dealt once and cut by checkpoint(), so a lost executor cannot deal them anew; only
    one count a range is summed up, in a window over as many rows as there are ranges.
    """
    spark = df.sparkSession
    shared_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_PART), 1)
    dealt = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    # One row a range: the bound is the number of partitions, which the driver tracks anyway.
    return (
        dealt.join(F.broadcast(offsets), "__part")
        .withColumn(out_col, F.col("__from") + F.col("__at"))
        .drop("__part", "__at", "__from")
    )


def assign(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Per row: id, size, text_crc32, row_number, place, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = numbered(narrow, [id_col, "size", "text_crc32"], "row_number")
    n = max(1, df.count())
    placed = permuted(rows, "row_number", n, "place", seed)
    return placed.select(
        id_col, "size", "text_crc32", "row_number", "place",
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("bigint").alias("slot"),
    )


#: DuckDB has no crc32: the table of 256 steps from its polynomial, then one step a byte.
CRC32_SQL = """
bit_steps AS (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS tbl
  FROM range(256) t(b)
), crc AS (
  SELECT doc_id, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS c
  FROM documents, bit_steps
)"""


def oracle_sql(n_shards: int = 8, seed: int = 0, rounds: int = ROUNDS) -> str:
    """DuckDB: the same permutation with a recursive walk."""
    # The bits of the halves depend on N, so every step carries them.
    def word(r, half):
        return f"(('0x' || substr(md5('{seed}:{r}:' || CAST({half} AS VARCHAR)), 1, 8))::BIGINT)"

    def mask(bits):
        return f"((1::BIGINT << ({bits})::INTEGER) - 1)"

    ctes, prev = [], "src"
    for r in range(rounds):
        small = "lb" if r % 2 == 0 else "rb"  # bits of the half that is replaced
        ctes.append((f"r{r}", f"SELECT * EXCLUDE (l, r), r AS l, xor(l, {word(r, 'r')} & {mask(small)}) AS r FROM {{prev}}"))
    steps = "SELECT *, v >> rb::INTEGER AS l, v & " + mask("rb") + " AS r FROM {prev}"

    def once(source):
        sql = steps.replace("{prev}", source)
        for _, body in ctes:
            sql = body.replace("{prev}", f"({sql})")
        return f"SELECT * EXCLUDE (l, r, v), (l << rb::INTEGER) | r AS v FROM ({sql})"

    return f"""
WITH RECURSIVE {CRC32_SQL}, src AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS t FROM documents
), numbered AS (
  SELECT doc_id, size, t, row_number() OVER (ORDER BY doc_id) - 1 AS v, count(*) OVER () AS n FROM src
), shaped AS (
  SELECT *, greatest(2, CASE WHEN n <= 1 THEN 0 ELSE length(ltrim(bin(n - 1), '0')) END) AS bits FROM numbered
), begun AS (
  SELECT doc_id, size, t, n, bits // 2 AS lb, bits - bits // 2 AS rb, v FROM shaped
), walk AS (
  {once('begun')}
  UNION ALL
  {once('(SELECT * FROM walk WHERE v >= n)')}
)
SELECT doc_id, size::BIGINT AS size, crc.c AS text_crc32, 'rows' AS law, (v % {n_shards})::INTEGER AS shard,
       (v // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM walk JOIN crc USING (doc_id) WHERE v < n
"""
