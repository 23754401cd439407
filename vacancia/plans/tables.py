"""Model tables (postings, applications, outcomes, ...) read from the given star schema.

``SQL_TABLES`` states each adapter once more in SQL for the comparison. Both read whole tables.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
HOSTS = {"N": "careers.example.com", "A": "gamejobs.co", "R": "www.gamedevjobs.com"}
# Status spelling per order status and priority: aliases, bold and dated forms of every state.
STATUS = {
    "F": ["Rejected", "**Rechazado**", "Discarded", "SKIP", "Evaluada"],
    "O": ["Applied", "Aplicado 2024-03-12", "Responded", "Interview", "Offer"],
    "P": ["Evaluated", "monitor", "Hold", "**Entrevista**", "Duplicado #12"],
}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ROLES = ["Senior Gameplay Engine Programmer", "Gameplay Engine Programmer", "Lead Technical Artist Rigging",
         "Level Designer Narrative Systems", "Backend Software Engineer API"]
REMOTE = {"AFRICA": "Remote, Africa", "AMERICA": "US only remote", "ASIA": "Hybrid, two days in the office",
          "EUROPE": "Remote anywhere", "MIDDLE EAST": ""}
GAPS = {"AUTOMOBILE": "No Python or React in production", "BUILDING": "US-only residency",
        "FURNITURE": "Wants a Director with Rust and Go", "HOUSEHOLD": "Hybrid in the office",
        "MACHINERY": "Docker, Kubernetes and C++"}


def _case(column: str, table: dict[str, str]) -> str:
    quoted = {k: v.replace("'", "''") for k, v in table.items()}
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + " END"


_HOST = _case("l_returnflag", HOSTS)
_ROLE = _case("o_orderpriority", dict(zip(PRIORITIES, ROLES)))
_STATUS = "CASE o_orderstatus " + " ".join(
    f"WHEN '{s}' THEN {_case('o_orderpriority', dict(zip(PRIORITIES, names)))}" for s, names in STATUS.items()) + " END"
_URL = ("CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'https://jobs.example.org/apply?gh_jid=' || "
        "CAST(100000 + l_partkey AS STRING) ELSE 'https://' || " + _HOST +
        " || '/' || CAST(l_suppkey AS STRING) || '/jobs/' || CAST(100000 + l_partkey AS STRING) END")
_APPLY = ("CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'https://www.careers.example.com/' || "
          "CAST(l_suppkey AS STRING) || '/jobs/' || CAST(100000 + l_partkey AS STRING) || '/' END")
_SCORE = ("CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS STRING) || '.' || "
          "CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) % 10 AS STRING) || '/5'")

_POSTING = {
    "title": "p_name || CASE WHEN l_returnflag = 'A' THEN ' - ' ELSE ' ' END || lower(p_type) || "
             "CASE WHEN l_linestatus = 'O' THEN ' (Remote)' ELSE '' END",
    "url": _URL,
    "company": "CASE l_returnflag WHEN 'N' THEN s_name WHEN 'A' THEN s_name || ' Studios' ELSE substr(s_name, 10) END",
    "location": "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '' WHEN l_linestatus = 'O' "
                "THEN n_name || ', ' || r_name || ', Remote' ELSE n_name || ', ' || r_name END",
    "applyUrl": _APPLY,
    "postedDate": "l_shipdate",
    "workMode": "CASE WHEN l_discount > 0.07 THEN 'hybrid' WHEN l_discount < 0.02 THEN 'onsite' END",
    "department": "p_type",
    "experienceLevel": "p_brand",
    "filtered": "l_quantity > 45",
}
_POSTING_FROM = ("lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
                 "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_APPLICATION = {
    "num": "o_orderkey", "pos": "o_orderkey", "company": "c_name", "role": _ROLE + " || ' ' || c_mktsegment",
    "score": _SCORE, "status": _STATUS, "pdf": "CASE WHEN o_orderstatus = 'O' THEN '✅' ELSE '❌' END",
    "report": "'[' || CAST(o_orderkey AS STRING) || '](' || CASE WHEN o_orderpriority = '5-LOW' THEN '../' ELSE '' END "
              "|| 'reports/' || CAST(o_orderkey AS STRING) || '.md)'",
    "notes": "'contact: Ann @ ann.' || CAST(c_custkey AS STRING) || '@mail.example.com'",
}
_ADDITION = {
    "file_seq": "o_orderkey",
    "num": "CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey + 1 ELSE o_orderkey END",
    "company": "c_name", "role": _ROLE + " || ' ' || c_mktsegment", "score": _SCORE, "status": _STATUS,
    "pdf": "'❌'",
    "report": "CASE WHEN o_orderpriority = '1-URGENT' THEN '[' || CAST(o_custkey AS STRING) || '](reports/x.md)' ELSE '' END",
    "notes": "'added'",
}
_REPORT = {
    "path": "CASE WHEN o_orderpriority = '5-LOW' THEN '../' ELSE '' END || 'reports/' || CAST(o_orderkey AS STRING) || '.md'",
    "archetype": "CASE WHEN o_orderpriority <> '3-MEDIUM' THEN substr(o_orderpriority, 3) END",
    "remote": _case("r_name", REMOTE),
    "teamSize": "CASE WHEN c_acctbal < 0 THEN 'small team' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) || ' people' END",
    "score": "floor(o_totalprice / 10000) / 10",
    "gap": _case("c_mktsegment", GAPS),
    "severity": "CASE WHEN o_orderstatus = 'P' THEN 'Nice to have' ELSE 'Hard' END",
}
_OUTCOME = {
    "event_id": "event_id", "ts": "ts", "company": "CAST(user_id AS STRING)", "run": "CAST(ts AS DATE)",
    "ok": "event_type <> 'error'", "source": "event_type",
    "kind": "CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 'throttled' WHEN value > 50 THEN 'blocked' ELSE 'http' END END",
    "error": "CASE WHEN event_type = 'error' THEN props END",
}
_COMPANY = {
    "seq": "s_suppkey",
    "name": "CASE WHEN s_acctbal < 2000 THEN s_name || ' (' || n_name || ')' ELSE s_name END",
    "careers_url": "CASE WHEN s_acctbal > 8000 THEN 'https://gamejobs.co/' || CAST(s_suppkey AS STRING) "
                   "WHEN s_acctbal > 6000 THEN NULL ELSE 'https://careers.example.com/' || CAST(s_suppkey AS STRING) || '/jobs' END",
    "api": "CASE WHEN s_acctbal > 7000 AND s_acctbal <= 8500 THEN 'https://api.example.net:443/v1/' || CAST(s_suppkey AS STRING) END",
    "endpoint": "CASE WHEN s_acctbal > 4000 AND s_acctbal < 6000 THEN 'https://jobs.example.io/list' END",
    "feed_url": "CASE WHEN s_acctbal < 2500 THEN 'https://feeds.gamejobs.co/rss' END",
    "job_url_template": "CASE WHEN s_acctbal < 500 THEN 'https://own.example.com/careers/' || CAST(s_suppkey AS STRING) || '/{slug}/{id}/' END",
    "provider": "CASE WHEN s_acctbal > 9000 THEN 'greenhouse' WHEN s_acctbal > 8500 THEN 'nope' END",
    "recipe": "CASE WHEN s_acctbal > 5000 AND s_acctbal < 6000 THEN 'html' WHEN s_acctbal > 4000 AND s_acctbal <= 5000 THEN 'blocked' END",
    "parser": "CASE WHEN s_acctbal > 3000 AND s_acctbal <= 3500 THEN 'python' END",
    "status": "CASE WHEN s_acctbal < 0 THEN 'unresolved' END",
    "enabled": "CASE WHEN s_acctbal < -500 THEN FALSE END",
    "country": "n_name",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


_ORDERS = "orders JOIN customer ON o_custkey = c_custkey"
SQL_TABLES = {
    "posting": f"SELECT {', '.join(SEQ)}, row_number() OVER (ORDER BY {', '.join(SEQ)}) AS seq, {_select(_POSTING)} FROM {_POSTING_FROM}",
    "application": f"SELECT {_select(_APPLICATION)}, strftime(o_orderdate, '%Y-%m-%d') AS date FROM {_ORDERS}",
    "existing": f"SELECT {_select(_APPLICATION)}, strftime(o_orderdate, '%Y-%m-%d') AS date FROM {_ORDERS} WHERE o_orderstatus <> 'P'",
    "addition": f"SELECT {_select(_ADDITION)}, strftime(o_orderdate, '%Y-%m-%d') AS date FROM {_ORDERS} WHERE o_orderstatus = 'P'",
    "report": f"SELECT {_select(_REPORT)} FROM {_ORDERS} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "follow_up": "SELECT l_orderkey AS appNum, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem",
    "outcome": f"SELECT {_select(_OUTCOME)} FROM events",
    "company": f"SELECT {_select(_COMPANY)} FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}


class Tables:
    """Frames of one data folder. Every property is lazy; joins are left to the optimizer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    # tables whose rows carry heavy text work
    _WIDE = ("lineitem", "orders", "events", "documents", "pages")

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._frames[name] = self._spread(df) if name in self._WIDE else df
        return self._frames[name]

    def _spread(self, df: DataFrame) -> DataFrame:
        """Tables are read as they are split. Only a session that asks for it, as local ones do for their one-file tables, deals rows out first."""
        parts = self.spark.conf.get("spark.vacancia.spread", None)
        return df.repartition(int(parts)) if parts else df

    def _orders(self) -> DataFrame:
        return self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))

    @staticmethod
    def _columns(columns: dict[str, str]) -> list[Column]:
        return [F.expr(sql).alias(name) for name, sql in columns.items()]

    @cached_property
    def posting(self) -> DataFrame:
        c = F.col
        joined = (self.read("lineitem").join(self.read("part"), c("l_partkey") == c("p_partkey"))
                  .join(self.read("supplier"), c("l_suppkey") == c("s_suppkey"))
                  .join(self.read("nation"), c("s_nationkey") == c("n_nationkey"))
                  .join(self.read("region"), c("n_regionkey") == c("r_regionkey")))
        # the order of landing as one number, so that minima over it are hash aggregates
        digits = [F.lpad(c(name).cast("long").cast("string"), n, "0") for name, n in zip(SEQ[:5], (10, 2, 9, 7, 2))]
        cents = F.lpad(F.round(c("l_extendedprice") * 100).cast("long").cast("string"), 8, "0")
        return joined.select(F.concat(*digits, cents).cast("decimal(38,0)").alias("seq"), F.struct(*SEQ).alias("landing"), *self._columns(_POSTING))

    @staticmethod
    def _day(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd").alias("date")

    @cached_property
    def application(self) -> DataFrame:
        return self._orders().select(*self._columns(_APPLICATION), self._day("o_orderdate"))

    @cached_property
    def existing(self) -> DataFrame:
        """Tracker rows: applications whose order is no longer pending."""
        return self._orders().filter("o_orderstatus <> 'P'").select(*self._columns(_APPLICATION), self._day("o_orderdate"))

    @cached_property
    def addition(self) -> DataFrame:
        """Rows to merge into the tracker: the pending orders."""
        return self._orders().filter("o_orderstatus = 'P'").select(*self._columns(_ADDITION), self._day("o_orderdate"))

    @cached_property
    def report(self) -> DataFrame:
        c = F.col
        joined = (self._orders().join(self.read("nation"), c("c_nationkey") == c("n_nationkey"))
                  .join(self.read("region"), c("n_regionkey") == c("r_regionkey")))
        gaps = F.array(F.struct(c("gap").alias("description"), c("severity"), F.lit("").alias("mitigation")))
        return joined.select(*self._columns(_REPORT)).withColumn("gaps", gaps)

    @cached_property
    def follow_up(self) -> DataFrame:
        return (self.read("lineitem")
                .select(F.col("l_orderkey").alias("appNum"), self._day("l_shipdate")))

    @cached_property
    def outcome(self) -> DataFrame:
        return self.read("events").select(*self._columns(_OUTCOME))

    @cached_property
    def company(self) -> DataFrame:
        return self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            *self._columns(_COMPANY))

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.read("pages")
