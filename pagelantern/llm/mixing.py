"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target share w of the mix and `chars` characters is to be repeated w * total / chars times on average.
Each document draws its number of copies from the Poisson distribution with that mean: a hash of its id and the seed
gives a number u between 0 and 1, and the count is the smallest k whose cumulative probability reaches u. A mean above
`STEP` is the sum of several draws with smaller means. The copies are exploded and shuffled globally by a hash of id
and copy number. Nothing depends on other documents but each source's total, so lost tasks are repeated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.llm.common import cut, table

STEP = 200.0
SMALL = 10_000  # sources, up to which their table is broadcast
UNIT = "cast(conv(substr(md5(concat_ws(':', '{salt}', coalesce(cast(doc_id as string), 'null'), cast({k} as string))), 1, 13), 16, 10) as bigint) / 4503599627370496d"


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, chars and rate, the mean number of copies, for each source of docs.

    weights: the target share of each source's characters, in any unit; a source without one gets none. If not
    given, shares are in proportion to the square root of a source's characters. The mix has about as many
    characters as docs. A null source is a source of its own, with the weight under the key None.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        target = F.sqrt("chars")
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name).cast("string")), F.lit(float(w))).otherwise(target)
    sizes = cut(sizes.withColumn("weight", target))
    whole = sizes.where("chars > 0").agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.expr("case when chars > 0 and all_weight > 0 then weight / all_weight * all_chars / chars else 0d end")
    return sizes.crossJoin(F.broadcast(whole)).select("source", "chars", rate.alias("rate"))  # one row


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """docs' rows, each as often as its draw says, with n_copies, copy_no (from 1) and mix_key, in shuffled order.

    docs: doc_id, text, source and any other columns. Equal doc_ids draw equal counts; a null doc_id draws as the
    word null. A source without characters (empty or null texts only) has rate 0 and is left out. The
    rows of a partition are sorted by mix_key, and its partition is the key's hash: a global shuffle.
    """
    rates = cut(source_rates(docs, weights).select(F.col("source").alias("of"), "rate"))
    draws = F.expr(f"cast(greatest(1, ceil(rate / {STEP})) as int)")
    last = F.expr("cast(ceil(mean + 12 * sqrt(mean) + 24) as int)")
    cdf = F.expr("""transform(aggregate(sequence(1, last), array(named_struct('p', exp(-mean), 'c', exp(-mean))),
        (a, k) -> array_append(a, named_struct('p', element_at(a, -1).p * mean / k, 'c', element_at(a, -1).c + element_at(a, -1).p * mean / k))),
        x -> x.c)""")
    rates = rates.where("rate > 0").withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws")).withColumn("last", last)
    rates = cut(rates.select("of", "draws", cdf.alias("cdf")))
    rates = F.broadcast(rates) if rates.count() <= SMALL else rates
    unit = UNIT.format(salt=seed, k="j")
    count = F.expr(f"aggregate(sequence(1, draws), 0, (n, j) -> n + aggregate(array({unit}), 0, (z, u) -> size(filter(cdf, c -> c < u))))")
    mixed = docs.join(rates, docs.source.eqNullSafe(rates["of"])).withColumn("n_copies", count).where("n_copies > 0").drop("of", "draws", "cdf")
    mixed = mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = f"md5(concat_ws(':', '{seed}-order', coalesce(cast(doc_id as string), 'null'), cast(copy_no as string)))"
    return mixed.withColumn("mix_key", F.expr(key)).repartition("mix_key").sortWithinPartitions("mix_key")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, mixed so that sources share it by the square roots of their sizes."""
    mixed = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy_no", "mix_key")


SQL = """
with recursive sizes as (
  select source, cast(coalesce(sum(length(text)), 0) as double) as chars from documents group by source),
whole as (select sum(chars) as all_chars, sum(sqrt(chars)) as all_weight from sizes where chars > 0),
rates as (
  select source, sqrt(chars) / all_weight * all_chars / chars as rate from sizes, whole where chars > 0),
means as (
  select source, rate, cast(greatest(1, ceil(rate / 200.0)) as int) as draws,
    rate / greatest(1, ceil(rate / 200.0)) as mean from rates where rate > 0),
cdf as (
  select source, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from means
  union all
  select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from cdf
  where k < cast(ceil(mean + 12 * sqrt(mean) + 24) as int)),
drawn as (
  select d.doc_id, d.source, j, cast('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), 'null') || ':' || j), 1, 13) as bigint) / 4503599627370496.0 as u
  from documents d join means m on d.source is not distinct from m.source, unnest(generate_series(1, m.draws)) as g(j)),
counts as (
  select doc_id, source, cast(sum((select count(*) from cdf where cdf.source is not distinct from drawn.source and c < u)) as int) as n_copies
  from drawn group by doc_id, source)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, n_copies, cast(copy_no as int) as copy_no,
  md5('mix-order:' || coalesce(cast(d.doc_id as varchar), 'null') || ':' || copy_no) as mix_key
from documents d join counts c on d.doc_id = c.doc_id and d.source is not distinct from c.source,
  unnest(generate_series(1, n_copies)) as g(copy_no)
where n_copies > 0
"""
