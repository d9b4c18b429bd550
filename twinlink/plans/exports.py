"""Pre-joined pair exports of any schema into canonical pairs (S3, P3, P6-P8), and test splits
replaced by shared exports.

An export has one row per labelled pair, columns ``<stem>_left`` and ``<stem>_right`` and a label; its
``ExportSpec`` says which stems become which attributes and how a price meets its currency.  Without an
id column a pair's id is its dataset, split, a hash of its content and its number among equal rows,
so ids (and the samples drawn by them) do not depend on files or partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.functions.text import merge_price_currency
from twinlink.operators.pairs import pack_pairs
from twinlink.sources.files import read_prejoined, write_pairs

SIDES = (("left", "l"), ("right", "r"))


@dataclass(frozen=True)
class ExportSpec:
    """``attrs``: (attribute, source stem) in the order of the pair.  ``currency``: the stem merged into the
    attribute ``price`` (strictly, or leniently with missing parts printed as 'nan')."""
    attrs: tuple[tuple[str, str], ...]
    price: str | None = None
    currency: str | None = None
    lenient: bool = False
    label: str = "label"
    id_col: str | None = None

    def __post_init__(self):
        names = [a for a, _ in self.attrs]
        if len(set(names)) != len(names) or (self.currency and self.price not in names):
            raise ValueError(f"attributes {names} with price {self.price!r}")

    def used(self) -> list[str]:
        stems = [s for _, s in self.attrs] + ([self.currency] if self.currency else [])
        return [f"{s}_{side}" for s in stems for side, _ in SIDES] + [self.label] + ([self.id_col] if self.id_col else [])

    def renamed(self) -> list[str]:
        names = [a for a, _ in self.attrs] + (["_currency"] if self.currency else [])
        return [f"{n}_{s}" for n in names for _, s in SIDES] + ["label"] + (["_id"] if self.id_col else [])


# Record-table columns (renamed by position), dropped attributes and the columns of the
# shared test exports, as the published data preparation has them.
RECORD_COLUMNS = {
    "abt": ["id", "name", "description", "price"],
    "amgo": ["id", "name", "manufacturer", "price"],
    "beer": ["id", "name", "factory", "style", "ABV"],
    "dbac": ["id", "title", "authors", "venue", "year"],
    "dbgo": ["id", "title", "authors", "venue", "year"],
    "foza": ["id", "name", "address", "city", "phone", "type", "class"],
    "itam": ["id", "name", "artist", "album", "genre", "price", "copyright", "time", "released"],
    "waam": ["id", "name", "category", "brand", "modelno", "price"],
}
DROPPED_COLUMNS = {"abt": ["description"], "amgo": ["manufacturer"], "waam": ["category", "brand"]}
_PAPERS = ExportSpec((("title", "title"), ("authors", "authors"), ("venue", "venue"), ("year", "year")))
SHARED_TESTS = {
    "abt": ExportSpec((("name", "name"), ("price", "price"))),
    "amgo": ExportSpec((("name", "title"), ("price", "price"))),
    "dbac": _PAPERS,
    "dbgo": _PAPERS,
    "waam": ExportSpec((("name", "title"), ("modelno", "modelno"), ("price", "price"))),
    "wdc": ExportSpec((("title", "title"),)),
}
PRODUCT_OFFERS = {
    "train": ExportSpec((("title", "title"), ("price", "price")), price="price", currency="priceCurrency"),
    "valid": ExportSpec((("title", "title"), ("price", "price")), price="price", currency="priceCurrency", lenient=True),
    "test": SHARED_TESTS["wdc"],
}

REPEAT_CHUNK = 100_000


def number_repeats(d: DataFrame, chunk: int = REPEAT_CHUNK) -> DataFrame:
    """``d`` with ``occurrence``, 1 to n among n equal rows.

    Equal rows are counted (map-side first, so copies of one row are no hot key) and counts are
    exploded again; a count above ``chunk`` is dealt out in chunks before its rows are made."""
    counts = d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("_n"))
    one = F.lit(1).cast("long")
    few = counts.where(F.col("_n") <= chunk).withColumn("occurrence", F.explode(F.sequence(one, F.col("_n"))))
    many = counts.where(F.col("_n") > chunk).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    many = many.repartition(*d.columns, "_from").withColumn("occurrence", F.explode(F.sequence(
        F.col("_from") * chunk + 1, F.least((F.col("_from") + 1) * chunk, F.col("_n")))))
    return few.drop("_n").unionByName(many.drop("_n", "_from"))


def content_hash(columns: list[str]) -> F.Column:
    """md5 over the columns in order of their names: ``-`` for null, else length, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
             for c in sorted(columns)]
    return F.md5(F.concat(*parts))


def export_pairs(spark: SparkSession, dataset: str, split: str, path: str, spec: ExportSpec, fmt: str = "parquet") -> DataFrame:
    """Canonical pairs of one export."""
    d = read_prejoined(spark, path, spec.used(), spec.renamed(), fmt)
    if spec.currency:
        merged = {f"{spec.price}_{s}": merge_price_currency(f"{spec.price}_{s}", f"_currency_{s}", lenient=spec.lenient)
                  for _, s in SIDES}
        d = d.withColumns(merged).drop("_currency_l", "_currency_r")
    if spec.id_col:
        pid = F.col("_id").cast("string")
    else:
        d = number_repeats(d)
        content = [c for c in d.columns if c != "occurrence"]
        pid = F.concat_ws("|", content_hash(content), F.col("occurrence").cast("string"))
    wide = d.withColumn("pair_id", F.concat_ws("|", F.lit(dataset), F.lit(split), pid)).drop("_id", "occurrence")
    return pack_pairs(wide, dataset, numeric=(), split=split)


def replace_splits(spark: SparkSession, root: str, exports: dict[str, tuple[str, ExportSpec]], split: str = "test",
                   fmt: str = "parquet") -> None:
    """Replace one split of the named datasets in stored pairs by their exports (dataset to path and
    spec); all other partitions stay as they are."""
    for dataset, (path, spec) in exports.items():
        write_pairs(export_pairs(spark, dataset, split, path, spec, fmt), root)
