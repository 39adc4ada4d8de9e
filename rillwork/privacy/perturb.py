"""Pseudonyms, encryption, swapping, rearrangement and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, name_of, names_of
from ..errors import ValidationError
from ..operators.project import numbered
from ..registry import Op, operator

#: The characters that random texts are made of.
ALPHABETS = {"ALPHABET": "abcdefghijklmnopqrstuvwxyz", "NUMBER": "0123456789", "MIXED": "abcdefghijklmnopqrstuvwxyz0123456789"}


def pseudonym_of(value: Column, method: str, length: int, key: str) -> Column:
    """A text of `length` characters that depends on the value and the key only."""
    letters = ALPHABETS[method]
    at = lambda i: F.pmod(F.xxhash64(value.cast("string"), F.lit(key), F.lit(i)), F.lit(len(letters))).cast("int") + 1
    return F.concat(*(F.substr(F.lit(letters), at(i), F.lit(1)) for i in range(length)))


def pseudonym_table(df: DataFrame, column: str, method: str = "MIXED", length: int = 6, key: str = "") -> DataFrame:
    """(value, pseudonym), one pseudonym per distinct value and no two alike: where short texts
    would collide, the rank among them is added. Keep this table to reverse the operator."""
    from pyspark.sql import Window

    values = df.select(col(column).alias("value")).where("value is not null").distinct().withColumn("p", pseudonym_of(F.col("value"), method, length, key))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("value")) - 1
    return values.withColumn("r", rank).select("value", F.when(F.col("r") == 0, F.col("p")).otherwise(F.concat("p", F.lit("-"), F.col("r").cast("string"))).alias("pseudonym"))


def _replace(df: DataFrame, c: str, table: DataFrame, old: str, new: str) -> DataFrame:
    keyed = table.select(F.col(old).alias("__o"), F.col(new).alias("__w"))
    return df.join(keyed, col(c) == F.col("__o"), "left").select(*(F.coalesce(F.col("__w"), col(x).cast("string")).alias(x) if x == c else col(x) for x in df.columns))


@operator("pseudonymize")
def pseudonymize(column: ColumnRef, method: str = "MIXED", length: int = 6, key: str = "", manual: list[tuple[str, str]] | None = None, table: DataFrame | None = None) -> Op:
    """Replace values by pseudonyms: from a keyed hash, a manual list, or a (value, pseudonym) table."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        if manual is not None:
            pairs = df.sparkSession.createDataFrame(manual, "value string, pseudonym string")
        else:
            pairs = table if table is not None else pseudonym_table(df, c, method, length, key)
        return _replace(df, c, pairs, "value", "pseudonym")

    return run


@operator("reveal_pseudonyms")
def reveal_pseudonyms(column: ColumnRef, table: DataFrame) -> Op:
    return lambda df: _replace(df, name_of(df, column), table, "pseudonym", "value")


def derived_key(key: str, derivation: str = "NORMAL") -> bytes:
    """16 bytes: the key itself, which must be that long, or the beginning of its SHA-1 or SHA-512."""
    import hashlib

    data = key.encode() if derivation == "NORMAL" else hashlib.new(derivation.lower(), key.encode()).digest()[:16]
    if len(data) not in (16, 24, 32):
        raise ValidationError("a key of 16, 24 or 32 bytes is needed")
    return data


@operator("encrypt")
def encrypt(columns: list[ColumnRef], key: str, derivation: str = "NORMAL", mode: str = "GCM") -> Op:
    """AES as base64. GCM by default; ECB, which shows equal values as equal, only on request. Built-in, no UDF."""
    data = derived_key(key, derivation)
    return lambda df: df.withColumns({c: F.base64(F.aes_encrypt(col(c).cast("string"), F.lit(data), F.lit(mode), F.lit("PKCS" if mode == "ECB" else "DEFAULT"))) for c in names_of(df, columns)})


@operator("decrypt")
def decrypt(columns: list[ColumnRef], key: str, derivation: str = "NORMAL", mode: str = "GCM") -> Op:
    """Undo `encrypt`; cells that can't be decrypted are null."""
    data = derived_key(key, derivation)
    return lambda df: df.withColumns({c: F.try_aes_decrypt(F.unbase64(col(c)), F.lit(data), F.lit(mode), F.lit("PKCS" if mode == "ECB" else "DEFAULT")).cast("string") for c in names_of(df, columns)})


@operator("swap_values")
def swap_values(column: ColumnRef, other: DataFrame | None = None, other_column: ColumnRef = 0, seed: int = 7) -> Op:
    """The i-th distinct value to the i-th distinct value of another table's column, wrapping around; without one, to
    a shuffle of the column's own values."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        own = df.select(col(c).cast("string").alias("v")).where("v is not null").distinct()
        pool = own if other is None else other.select(col(name_of(other, other_column)).cast("string").alias("v")).where("v is not null").distinct()
        pool = pool.select("v", F.xxhash64("v", F.lit(seed)).alias("h"))
        a = numbered(own, ["v"], "__i")
        b = numbered(pool, ["h", "v"] if other is None else ["v"], "__j").select(F.col("v").alias("w"), "__j")
        n = b.agg(F.count("*")).first()[0]
        if not n:
            return df
        pairs = a.join(b, F.pmod(F.col("__i") - 1, F.lit(n)) + 1 == F.col("__j")).select(F.col("v").alias("value"), F.col("w").alias("pseudonym"))
        return _replace(df, c, pairs, "value", "pseudonym")

    return run


@operator("rearrange")
def rearrange(columns: list[ColumnRef], order_by: list[ColumnRef], pairs: list[tuple[int, int]] | None = None, ratio: float = 0.001, together: bool = False, seed: int = 7) -> Op:
    """Swap cells between pairs of rows: given row numbers (from 0 in the declared order), or a random `ratio` of the
    rows; each column by pairs of its own, or all `together`."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns)
        rows = numbered(df, names_of(df, order_by), "__r").withColumn("__r", F.col("__r") - 1)

        def moves(i: int) -> DataFrame:
            if pairs is not None:
                both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
                return df.sparkSession.createDataFrame(both, "__to long, __from long")
            drawn = rows.select("__r", F.xxhash64("__r", F.lit(seed + i)).alias("h")).where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * min(1.0, 2 * ratio)))
            at = numbered(drawn, ["h", "__r"], "__n")
            a = at.select(F.col("__r").alias("__a"), F.floor((F.col("__n") - 1) / 2).alias("p"), ((F.col("__n") - 1) % 2).alias("s"))
            return a.alias("x").join(a.alias("y"), F.expr("x.p = y.p and x.s <> y.s")).select(F.col("x.__a").alias("__to"), F.col("y.__a").alias("__from"))

        for i, part in enumerate([chosen] if together else [[c] for c in chosen]):
            source = rows.select(F.col("__r").alias("__from"), *(col(c).alias(f"__s_{c}") for c in part)).join(moves(i), "__from").withColumn("__hit", F.lit(True)).drop("__from")
            rows = rows.join(source, rows["__r"] == source["__to"], "left").select(*(F.when(F.col("__hit"), col(f"__s_{c}")).otherwise(col(c)).alias(c) if c in part else col(c) for c in [*df.columns, "__r"]))
        return rows.select(*map(col, df.columns))

    return run


@operator("add_noise")
def add_noise(columns: list[ColumnRef], kind: str = "GAUSSIAN", op: str = "NOISE_SUM", value: float = 1.0, mu: float = 0.0, sigma: float = 1.0, position: int = 0, length: int = 3, text: str = "MIXED", seed: int = 7) -> Op:
    """Numbers (also inside texts) +, -, x or / a fixed, uniform [0, value) or normal number; texts without a number
    get a random text at `position`. The same seed and partitioning give the same noise."""

    def run(df: DataFrame) -> DataFrame:
        change = {}
        for i, c in enumerate(names_of(df, columns)):
            noise = {"FIXED": F.lit(value), "RANDOM": F.rand(seed + i) * value, "GAUSSIAN": F.randn(seed + i) * sigma + mu}[kind]
            apply = {"NOISE_SUM": lambda x, n: x + n, "NOISE_MINUS": lambda x, n: x - n, "NOISE_MULTIPLY": lambda x, n: x * n, "NOISE_DIVIDE": lambda x, n: F.try_divide(x, n)}[op]
            if is_numeric(df, c):
                change[c] = apply(col(c).cast("double"), noise)
                continue
            from .mask import EMBEDDED, around, embedded

            letters = ALPHABETS[text]
            pick = F.concat(*(F.substr(F.lit(letters), (F.rand(seed + i * 101 + j) * len(letters)).cast("int") + 1, F.lit(1)) for j in range(length)))
            mixed = around(col(c), apply(embedded(col(c)), noise).cast("string"))
            change[c] = F.when(col(c).rlike(EMBEDDED), mixed).otherwise(F.concat(F.substring(col(c), 1, position), pick, F.substr(col(c), F.lit(position + 1), F.length(col(c)))))
        return df.withColumns(change)

    return run
