"""The engine's queries by name, and the same relations as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.operators import joins, partitioning, relational
from joinloom.plans import experiments
from joinloom.plans import queries as plans
from joinloom.sources import raw, workloads
from joinloom.sources.tables import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Workloads as DuckDB SQL: keys are permutations of positions, in closed form.
PK = "(select i pos, (i * 2654435761 + 42) % 1024 k from range(1024) t(i))"
FK = "(select i pos, (((i * 40503 + 7) % 4096) % 1024 * 2654435761 + 42) % 1024 k from range(4096) t(i))"
WEIGHTS = "(select i + 1 i, 1048576 // (i + 1) w from range(256) t(i))"
SPANS = f"(select i k, s - w lo, s hi from (select i, w, cast(sum(w) over (order by i rows unbounded preceding) as bigint) s from {WEIGHTS}))"
HALF = "(select i + 1 i, cast(floor(sqrt(cast(1099511627776 // (i + 1) as double))) as bigint) w from range(256) t(i))"
HALF_SPANS = SPANS.replace(WEIGHTS, HALF)
HALF_ZIPF = f"(select z.k from (select (n * 2654435761 + 12345) % (select cast(sum(w) as bigint) from {HALF}) u from range(4096) t(n)) d join {HALF_SPANS} z on d.u >= z.lo and d.u < z.hi)"
ZIPF = f"(select z.k from (select (n * 2654435761 + 12345) % 6421731 u from range(4096) t(n)) d join {SPANS} z on d.u >= z.lo and d.u < z.hi)"
GRID = """(select nr, ratio, pr, ps, dist, 'pkfk' join_type, uk unique_keys, cast(z * 0.25 as double) zipf_factor, selectivity, algo, 9 p, q
  from range(20, 29) a(nr), range(0, 8) b(ratio), range(1, 7) c(pr), range(1, 7) d(ps), (values ('uniform'), ('zipf')) e(dist), range(21, 30) f(uk), range(0, 9) g(z),
       (values (1), (2), (4), (8), (16)) h(selectivity), (values ('smj'), ('phj'), ('shj'), ('smji')) l(algo), (values (6), (7)) m(q)
  where not (dist = 'uniform' and z <> 0) and not (dist = 'zipf' and selectivity <> 1) and not (algo in ('smj', 'smji') and q <> 6) and nr + ratio < 31)"""
ORDERS_LINES = "select o_orderkey k, o_totalprice r1, o_orderdate r2, l_quantity s1, l_suppkey s2 from orders join lineitem on o_orderkey = l_orderkey"
N_PK, N_FK, ALPHABET = 1024, 4096, 256


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shifted(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.col("k") - 1)


@query("scan_lineitem", "select l_orderkey, l_quantity from lineitem")
def scan_lineitem(spark, d):
    return scan(spark, d, "lineitem", "l_orderkey", "l_quantity")


@query("scan_cast", "select cast(n_nationkey as bigint) n_nationkey, n_name from nation")
def scan_cast(spark, d):
    return scan(spark, d, "nation", "n_nationkey", "n_name", n_nationkey="bigint")


@query("raw_column_roundtrip", "select cast(row_number() over (order by l_orderkey) - 1 as bigint) pos, l_orderkey from lineitem")
def raw_column_roundtrip(spark, d):
    """The order keys, sorted, as raw files and back; pos is their place in the files."""
    sorted_ = scan(spark, d, "lineitem", "l_orderkey").orderBy("l_orderkey")
    return raw.read_raw(spark, raw.write_raw(spark, sorted_, "l_orderkey"), "l_orderkey", "bigint")


@query("materialize_filtered", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F'")
def materialize_filtered(spark, d):
    return relational.filtered(scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderstatus") == "F").drop("o_orderstatus")


def _shipped(spark, d, first, last):
    return relational.filtered(scan(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate"), relational.in_range("l_shipdate", plans.day(first), plans.day(last)))


@query("filter_date_range", "select l_orderkey, l_suppkey, l_shipdate from lineitem where l_shipdate between timestamp '1995-01-01' and timestamp '1996-12-31'")
def filter_date_range(spark, d):
    return _shipped(spark, d, "1995-01-01", "1996-12-31")


@query("filter_date_bounds", "select l_orderkey, l_suppkey, l_shipdate from lineitem where l_shipdate between timestamp '1997-03-01' and timestamp '1998-02-28'")
def filter_date_bounds(spark, d):
    """A range whose both ends cut off rows."""
    return _shipped(spark, d, "1997-03-01", "1998-02-28")


@query("filter_chain", "select l_orderkey, l_quantity from lineitem where l_linestatus = 'O' and l_quantity < 10")
def filter_chain(spark, d):
    return relational.filtered(scan(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_linestatus"), F.col("l_linestatus") == "O", F.col("l_quantity") < 10).drop("l_linestatus")


@query("filter_in_and_eq", "select l_partkey, l_quantity from lineitem where l_returnflag in ('A', 'R') and l_linestatus = 'O'")
def filter_in_and_eq(spark, d):
    lines = scan(spark, d, "lineitem", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return relational.filtered(lines, F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "O")).drop("l_returnflag", "l_linestatus")


@query("filter_pair_or", "select s_suppkey, c_custkey, s_nationkey, c_nationkey from supplier join customer on s_suppkey = c_custkey where (s_nationkey = 7 and c_nationkey = 8) or (s_nationkey = 8 and c_nationkey = 7) or s_nationkey = c_nationkey")
def filter_pair_or(spark, d):
    customers = scan(spark, d, "customer", "c_custkey", "c_nationkey").withColumn("key", F.col("c_custkey"))
    joined = joins.equi_join(scan(spark, d, "supplier", "s_suppkey", "s_nationkey"), customers, ("s_suppkey", "key"))
    return relational.filtered(joined, relational.either_way("s_nationkey", "c_nationkey", 7, 8) | (F.col("s_nationkey") == F.col("c_nationkey"))).select("s_suppkey", "c_custkey", "s_nationkey", "c_nationkey")


@query("project_reorder", "select o_totalprice, o_orderkey, o_orderdate from orders")
def project_reorder(spark, d):
    return relational.projected(scan(spark, d, "orders"), "o_totalprice", "o_orderkey", "o_orderdate")


@query("project_computed", "select l_orderkey, l_linenumber, l_partkey + l_suppkey ps, l_extendedprice * (1 - l_discount) volume from lineitem")
def project_computed(spark, d):
    return relational.projected(scan(spark, d, "lineitem"), "l_orderkey", "l_linenumber", ps=F.col("l_partkey") + F.col("l_suppkey"), volume=F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("filter_then_join", "select p_partkey, p_size, l_quantity from part join lineitem on p_partkey = l_partkey where l_linestatus = 'O'")
def filter_then_join(spark, d):
    lines = relational.filtered(scan(spark, d, "lineitem", "l_partkey", "l_quantity", "l_linestatus"), F.col("l_linestatus") == "O").drop("l_linestatus")
    return joins.equi_join(scan(spark, d, "part", "p_partkey", "p_size"), lines, ("p_partkey", "l_partkey"))


@query("gather_by_rowid", "select l_orderkey idx, o_totalprice from lineitem join orders on o_orderkey = l_orderkey")
def gather_by_rowid(spark, d):
    at = scan(spark, d, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "idx")
    return relational.gathered(scan(spark, d, "orders", "o_orderkey", "o_totalprice"), at, "o_orderkey", "idx")


@query("row_ids", "select cast(row_number() over (order by o_orderkey) - 1 as bigint) rid, o_orderkey from orders")
def row_ids(spark, d):
    return relational.row_ids(spark, scan(spark, d, "orders", "o_orderkey"), ["o_orderkey"])


@query("peek_topn", "select o_orderkey, o_custkey from orders order by o_orderkey limit 10")
def peek_topn(spark, d):
    return relational.peek(scan(spark, d, "orders", "o_orderkey", "o_custkey"), 10, "o_orderkey")


@query("count_selected", "select count(*) n from lineitem where l_linestatus = 'O'")
def count_selected(spark, d):
    return relational.counted(relational.filtered(scan(spark, d, "lineitem", "l_linestatus"), F.col("l_linestatus") == "O"))


def orders_lines(spark, d, strategy="AUTO"):
    orders = scan(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderdate").toDF("k", "r1", "r2")
    return joins.equi_join(orders, scan(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_suppkey").toDF("k", "s1", "s2"), "k", strategy)


for _name, _strategy in (("inner_eq", "AUTO"), ("smj", "SMJ"), ("smji", "SMJI"), ("shj", "SHJ"), ("phj", "PHJ")):
    query(f"join_{_name}", ORDERS_LINES)(lambda spark, d, s=_strategy: orders_lines(spark, d, s))


def _pkfk_sql(key: str, payload: str) -> str:
    return f"select r.k k, cast(r.k as {payload}) r1, cast(r.k as {payload}) r2, cast(s.k as {payload}) s1 from (select cast(k as {key}) k from {PK}) r join (select cast(k as {key}) k from {FK}) s on r.k = s.k"


def _pkfk(spark, key, payload):
    r = workloads.with_payload(workloads.primary_keys(spark, N_PK, key), ["r1", "r2"], payload)
    return joins.equi_join(r, workloads.with_payload(workloads.uniform_keys(spark, N_FK, N_PK, key), ["s1"], payload), "k")


for _name, _key, _payload in (("4b4b", "int", "int"), ("4b8b", "int", "bigint"), ("8b8b", "bigint", "bigint")):
    query(f"join_pkfk_{_name}", _pkfk_sql(_key, _payload))(lambda spark, d, k=_key, p=_payload: _pkfk(spark, k, p))

SEL4 = f"select r.k k, r.k r1, s.k s1 from (select case when pos % 4 = 0 then k else k + 1073741824 end k from {PK}) r join {FK} s on r.k = s.k"


def _one(r: DataFrame, s: DataFrame, strategy: str = "AUTO") -> DataFrame:
    return joins.equi_join(workloads.with_payload(r, ["r1"]), workloads.with_payload(s, ["s1"]), "k", strategy)


@query("join_pkfk_sel4", SEL4)
def join_pkfk_sel4(spark, d):
    return _one(workloads.missed(workloads.primary_keys(spark, N_PK), 4), workloads.uniform_keys(spark, N_FK, N_PK))


@query("join_pkfk_zipf1", f"select r.k k, r.k r1, s.k s1 from (select i + 1 k from range(256) t(i)) r join {ZIPF} s on r.k = s.k")
def join_pkfk_zipf1(spark, d):
    return _one(spark.range(1, ALPHABET + 1).withColumnRenamed("id", "k"), workloads.zipf_keys(spark, N_FK, ALPHABET, 1))


@query("join_pkfk_zipf_half", f"select r.k k, r.k r1, s.k s1 from (select i + 1 k from range(256) t(i)) r join {HALF_ZIPF} s on r.k = s.k")
def join_pkfk_zipf_half(spark, d):
    return _one(spark.range(1, ALPHABET + 1).withColumnRenamed("id", "k"), workloads.zipf_keys(spark, N_FK, ALPHABET, 0.5))


@query("join_fkfk", "select r.k k, r.pos r1, s.pos s1 from (select i pos, i % 128 k from range(512) t(i)) r join (select i pos, i % 128 k from range(1024) t(i)) s on r.k = s.k")
def join_fkfk(spark, d):
    r, s = (workloads.cyclic_keys(spark, n, 128).select("k", F.col("pos").alias(c)) for n, c in ((512, "r1"), (1024, "s1")))
    return joins.equi_join(r, s, "k")


@query("join_count", f"select count(*) n from ({ORDERS_LINES})")
def join_count(spark, d):
    return joins.cardinality(orders_lines(spark, d))


@query("join_checksum", f"select count(*) n, cast(sum(k) as bigint) key_sum from ({ORDERS_LINES})")
def join_checksum(spark, d):
    return joins.checksum(orders_lines(spark, d), "k")


@query("match_ratio", f"select cast(count(*) as double) / 4096 ratio from ({SEL4})")
def match_ratio(spark, d):
    return joins.match_ratio(join_pkfk_sel4(spark, d), N_FK)


def _star_sql() -> str:
    keys = ", ".join(f"((i * {3 + 2 * j} + {j}) % 2000) % 256 fk{j}" for j in range(8))
    dims = " ".join(f"join (select i k, i * 10 p from range(256) t(i)) d{j} on d{j}.k = f.fk{j}" for j in range(8))
    return f"select f.fk7 k, {', '.join(f'd{j}.p p{j}' for j in reversed(range(8)))}, tid from (select i tid, {keys} from range(2000) t(i)) f {dims}"


@query("star_join_8", _star_sql())
def star_join_8(spark, d):
    return plans.star_join_8(spark)


Q7 = "select l_orderkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, n_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_shipdate between timestamp '{}' and timestamp '{}'"
query("q7_shape", Q7.format("1995-01-01", "1996-12-31"))(plans.q7)
query("q7_shape_bounds", Q7.format("1997-03-01", "1998-02-28"))(lambda spark, d: plans.q7(spark, d, first="1997-03-01", last="1998-02-28"))
query("q18_shape", "select o_orderkey, c_name, o_orderdate, o_totalprice, l_quantity from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey")(plans.q18)
query("q19_shape", "select p_partkey, p_brand, p_type, p_size, l_quantity, l_extendedprice, l_discount from part join lineitem on l_partkey = p_partkey where l_returnflag in ('A', 'R') and l_linestatus = 'O'")(plans.q19)
query("q64_shape", "select p_partkey, p_brand, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate from part join lineitem on p_partkey = l_partkey")(plans.q64)
query("q95_shape", "select a.l_orderkey order_number, a.l_suppkey wh1, b.l_suppkey wh2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey")(plans.q95)


def _keys(spark, d):
    return scan(spark, d, "lineitem", "l_orderkey")


@query("radix_histogram", "select l_orderkey & 63 part, count(*) n from lineitem group by 1")
def radix_histogram(spark, d):
    return partitioning.histogram(_keys(spark, d), "l_orderkey", 6)


@query("radix_partition_offsets", "select part, n, cast(sum(n) over (order by part rows unbounded preceding) as bigint) end_offset from (select p.part, count(l_orderkey) n from (select i part from range(32768) t(i)) p left join lineitem on l_orderkey & 32767 = p.part group by 1)")
def radix_partition_offsets(spark, d):
    return partitioning.offsets(_keys(spark, d), "l_orderkey", 15)


@query("radix_two_level", "select (l_orderkey >> 6) & 511 p1, l_orderkey & 63 p2, count(*) n from lineitem group by all")
def radix_two_level(spark, d):
    return partitioning.two_level(_keys(spark, d), "l_orderkey", 9, 6)


@query("skew_work_units", "select part, u unit, least(256, n - u * 256) len from (select l_orderkey & 63 part, count(*) n from lineitem group by 1), range(1000000) t(u) where u * 256 < n")
def skew_work_units(spark, d):
    return partitioning.work_units(_keys(spark, d), "l_orderkey", 6, 256)


@query("sort_keys", "select cast(row_number() over (order by o_orderkey) as bigint) rn, o_orderkey k from orders")
def sort_keys(spark, d):
    return relational.row_ids(spark, scan(spark, d, "orders", "o_orderkey").toDF("k"), ["k"], "rn", 1)


query("gen_pk", f"select k from {PK}")(lambda spark, d: workloads.primary_keys(spark, N_PK).select("k"))
query("gen_shuffle", f"select k from {PK}")(lambda spark, d: workloads.positions(spark, N_PK).select(workloads.permuted(F.col("pos"), N_PK).alias("k")))
query("gen_fk_uniform", f"select k, count(*) n from {FK} group by 1")(lambda spark, d: workloads.uniform_keys(spark, N_FK, N_PK).groupBy("k").agg(F.count("*").alias("n")))
query("gen_fk_zipf", f"select k, count(*) n from {ZIPF} group by 1")(lambda spark, d: workloads.zipf_keys(spark, N_FK, ALPHABET, 1).groupBy("k").agg(F.count("*").alias("n")))
query("gen_constant", "select 7 k from range(100) t(i)")(lambda spark, d: workloads.constant(spark, 100, 7))

query("grid_size", f"select count(*) n from {GRID}")(lambda spark, d: relational.counted(experiments.grid(spark)))
for _name, _where in experiments.CHOICES.items():
    query(f"grid_{_name}", f"select distinct * from {GRID} where {_where} and {experiments._BITS}")(lambda spark, d, n=_name: experiments.choice(spark, n))
