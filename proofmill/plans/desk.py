"""The review desk over orders (papers) and events (actions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofmill.operators import desk, ordered
from proofmill.plans.registry import query
from proofmill.session import table
from proofmill.streaming import claims

STATUS = ["done", "needs_author", "new", "editing", "done"]
QA = ["passed", "failed", "", "failed", ""]


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), n)


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper"), (F.col("o_orderstatus") != "P").alias("prepared"), _pick(STATUS, n).alias("status"), _pick(QA, (F.col("o_custkey") % 5 + 1).cast("int")).alias("qa"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("e"), (F.col("o_custkey") % 4).cast("string"))).alias("holder"), (F.col("o_custkey") % 6).alias("remote"), F.nullif((F.col("o_orderkey") % 5), F.lit(4)).alias("local"), F.col("o_orderdate").alias("at"),
    )


PAPERS = f"""p AS (SELECT o_orderkey AS paper, o_orderstatus <> 'P' AS prepared, {STATUS}[left(o_orderpriority, 1)::INT] AS status, {QA}[(o_custkey % 5 + 1)::INT] AS qa,
  CASE WHEN o_custkey % 3 > 0 THEN 'e' || (o_custkey % 4) END AS holder, o_custkey % 6 AS remote, nullif(o_orderkey % 5, 4) AS local, o_orderdate AS at FROM orders),
s AS (SELECT *, CASE WHEN NOT prepared THEN 'unprepared' WHEN status = 'done' THEN CASE WHEN qa = 'passed' THEN 'qa_passed' ELSE 'to_qa' END WHEN status = 'needs_author' THEN 'waiting_author' WHEN qa = 'failed' THEN 'to_reedit' ELSE 'to_edit' END AS stage FROM p)"""


@query(f"""WITH {PAPERS} SELECT paper, stage, CASE WHEN stage IN ('to_edit', 'waiting_author', 'to_reedit') THEN 'edit' WHEN stage = 'to_qa' THEN 'qa' ELSE '' END AS take,
CASE WHEN local IS NULL THEN '' WHEN remote > local AND status <> 'new' THEN 'both' WHEN remote > local THEN 'indico' WHEN status <> 'new' THEN 'local' ELSE 'same' END AS newer,
CASE WHEN holder IS NOT NULL AND holder <> 'e1' THEN 'held' WHEN prepared AND status IN ('done', 'needs_author') THEN 'finished' ELSE '' END AS left_alone FROM s""")
def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = _papers(spark, sf_dir).withColumn("stage", desk.stage(c("prepared"), c("status"), c("qa")))
    return out.select("paper", "stage", desk.taken_for(c("stage")).alias("take"), desk.newer(c("remote"), c("local"), c("status") != "new").alias("newer"), desk.left_alone(c("holder"), F.lit("e1"), c("prepared"), c("status")).alias("left_alone"))


@query("""SELECT event_id, CASE WHEN date_trunc('hour', d) = d THEN d ELSE date_trunc('hour', d) + INTERVAL 1 HOUR END AS deadline FROM (SELECT event_id, ts + INTERVAL 48 HOUR AS d FROM events)
UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 48 HOUR FROM orders""")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days on, up to the hour: events at any moment, orders on the hour."""
    ours = table(spark, sf_dir, "events").select("event_id", desk.deadline(F.col("ts")).alias("deadline"))
    return ours.unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), desk.deadline(F.col("o_orderdate")).alias("deadline")))


@query("""WITH c AS (SELECT o_orderkey AS paper, CASE WHEN o_custkey % 5 = 0 THEN o_orderdate END AS applied, o_custkey % 2 = 0 AS tasks_done, CASE WHEN o_custkey % 7 = 0 THEN 'declined' END AS reply, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS sent, o_custkey % 4 = 0 AS changed, o_orderdate + INTERVAL 48 HOUR AS due, o_orderstatus <> 'P' AS compared, o_orderstatus = 'F' AS differs, o_custkey % 11 = 0 AS unreadable FROM orders)
SELECT paper, CASE WHEN applied IS NOT NULL THEN CASE WHEN tasks_done THEN 'done' ELSE 'applied' END WHEN reply = 'declined' THEN 'replied' WHEN sent IS NOT NULL THEN CASE WHEN changed THEN 'changed' WHEN TIMESTAMP '1998-01-01' >= due THEN 'due' ELSE 'waiting' END WHEN NOT compared THEN 'unknown' WHEN differs THEN 'differs' WHEN unreadable THEN 'unknown' ELSE 'match' END AS status FROM c""")
def title_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_custkey"), F.col("o_orderdate")
    c = {"applied": F.when(k % 5 == 0, at), "tasks_done": k % 2 == 0, "reply": F.when(k % 7 == 0, "declined"), "sent": F.when(k % 3 == 0, at), "changed": k % 4 == 0, "due": at + F.expr("INTERVAL 48 HOURS"), "compared": F.col("o_orderstatus") != "P", "differs": F.col("o_orderstatus") == "F", "unreadable": k % 11 == 0}
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), desk.title_status(c, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).alias("status"))


@query("""SELECT o_orderkey AS paper, count(*) FILTER (l_returnflag = 'A') AS decided, count(*) FILTER (l_returnflag = 'N') AS to_decide, count(*) FILTER (l_quantity < 10) AS must_fix, count(*) FILTER (l_quantity BETWEEN 10 AND 30) AS worth_a_look,
CASE WHEN count(*) FILTER (l_returnflag IN ('A', 'N')) = 0 THEN 1.0 ELSE count(*) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag IN ('A', 'N')) END AS progress FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each paper's row in the worklist; a paper without lines has its row too."""
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.count_if(flag == "A").alias("decided"), F.count_if(flag == "N").alias("to_decide"), F.count_if(q < 10).alias("must_fix"), F.count_if(q.between(10, 30)).alias("worth_a_look"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper")).join(n, "paper", "left").fillna(0)
    return rows.withColumn("progress", desk.progress(F.col("decided"), F.col("to_decide")))


@query("""WITH c AS (SELECT o_orderkey AS paper, 'e' || (o_custkey % 4) AS who, CASE WHEN o_orderstatus = 'F' THEN 'edit' ELSE 'qa' END AS mode FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT l_orderkey AS paper, 'e' || (min(l_partkey) % 4) AS editor FROM lineitem GROUP BY 1)
SELECT paper, CASE WHEN who IS NOT NULL AND editor IS NOT NULL THEN CASE WHEN who = editor THEN 'both' WHEN mode = 'edit' THEN 'conflict' ELSE 'here' END WHEN who IS NOT NULL THEN 'here' ELSE 'indico' END AS taken, who AS here, editor AS remote FROM c FULL JOIN a USING (paper)""")
def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims here against assignments elsewhere."""
    here = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("paper"), F.concat(F.lit("e"), (F.col("o_custkey") % 4).cast("string")).alias("who"), F.when(F.col("o_orderstatus") == "F", "edit").otherwise("qa").alias("mode"))
    there = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.concat(F.lit("e"), (F.min("l_partkey") % 4).cast("string")).alias("editor"))
    return desk.holders(here, there)


def _edits(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    word = lambda c, m: (F.col(c) % m).cast("string")
    return items.groupBy(F.col("l_suppkey").alias("paper"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")).agg(F.max("l_partkey").alias("k")).select("paper", "id", F.lit("f").alias("file"), word("k", 3).alias("check_id"), word("k", 4).alias("before"), word("k", 5).alias("after"), word("k", 2).alias("left"), word("k", 7).alias("right"))


@query("""WITH RECURSIVE e AS (SELECT l_returnflag AS flag, l_suppkey AS paper, l_orderkey || '-' || l_linenumber AS id, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT *, k % 3 || '/' || k % 4 || '/' || k % 5 AS loose, k % 2 || '/' || k % 7 AS fine FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY paper, loose ORDER BY id) AS n FROM f WHERE flag = 'A'),
w AS (SELECT paper, loose, list({'id': id, 'fine': fine} ORDER BY id) AS free FROM f WHERE flag = 'R' GROUP BY 1, 2),
h AS (SELECT o.paper, o.loose, 0::BIGINT AS n, ''::VARCHAR AS old_id, coalesce(w.free, []) AS free, NULL::VARCHAR AS new_id, ''::VARCHAR AS how FROM o LEFT JOIN w USING (paper, loose) WHERE o.n = 1
  UNION ALL SELECT paper, loose, n, old_id, list_filter(free, lambda x: x.id IS DISTINCT FROM took), took, CASE WHEN took IS NULL THEN 'dropped' WHEN equal IS NOT NULL THEN 'exact' ELSE 'near' END
  FROM (SELECT *, CASE WHEN equal IS NOT NULL THEN equal WHEN len(free) = 1 THEN free[1].id END AS took FROM (SELECT h.paper, h.loose, o.n, o.id AS old_id, h.free, list_filter(h.free, lambda x: x.fine = o.fine)[1].id AS equal FROM h JOIN o ON o.paper = h.paper AND o.loose = h.loose AND o.n = h.n + 1)))
SELECT paper, old_id, new_id, how FROM h WHERE n > 0""")
def carried_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on returned lines, carried over to refused ones."""
    return desk.carry_over(_edits(spark, sf_dir, "A"), _edits(spark, sf_dir, "R"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(k % 10 < 5, "take").when(k % 10 < 8, "release").when(k % 10 == 8, "take_over").otherwise("free")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("e"), (k % 3).cast("string")).alias("who"))


ACTIONS = """a AS (SELECT user_id AS paper, event_id AS seq, CASE WHEN k % 10 < 5 THEN 'take' WHEN k % 10 < 8 THEN 'release' WHEN k % 10 = 8 THEN 'take_over' ELSE 'free' END AS action, 'e' || (k % 3) AS who, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
h AS (SELECT paper, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS who, false AS accepted, NULL::VARCHAR AS holder FROM a WHERE n = 1
  UNION ALL SELECT a.paper, a.n, a.seq, a.action, a.who,
    CASE a.action WHEN 'take' THEN h.holder IS NULL OR h.holder = a.who WHEN 'release' THEN coalesce(h.holder = a.who, false) WHEN 'take_over' THEN true ELSE h.holder IS NOT NULL END,
    CASE a.action WHEN 'take' THEN coalesce(h.holder, a.who) WHEN 'release' THEN CASE WHEN h.holder = a.who THEN NULL ELSE h.holder END WHEN 'take_over' THEN a.who END
  FROM h JOIN a ON a.paper = h.paper AND a.n = h.n + 1)"""


@query(f"WITH RECURSIVE {ACTIONS} SELECT paper, seq, action, who, accepted, holder FROM h WHERE n > 0")
def claim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action on a claim, whether it was accepted, and who holds the paper then."""
    return claims.history(actions(spark, sf_dir))


@query(f"WITH RECURSIVE {ACTIONS} SELECT paper, last(holder ORDER BY n) AS holder, max(n) AS n_actions, count(*) FILTER (accepted AND action = 'free') AS freed, count(*) FILTER (NOT accepted) AS refused FROM h WHERE n > 0 GROUP BY paper")
def claim_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds each paper after all its actions."""
    history = claims.history(actions(spark, sf_dir))
    of = history.groupBy("paper").agg(F.max_by("holder", "seq").alias("holder"), F.count(F.lit(1)).alias("n_actions"), F.count_if(F.col("accepted") & (F.col("action") == "free")).alias("freed"), F.count_if(~F.col("accepted")).alias("refused"))
    return of


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS wanted, max(ts) AS at, count(*) AS wants FROM events WHERE event_type <> 'view' GROUP BY 1")
def desired_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest wish of each paper stands."""
    wants = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    n = wants.groupBy("user_id").agg(F.count(F.lit(1)).alias("wants"))
    return desk.latest(wants.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").join(n, "user_id").select("user_id", F.col("event_type").alias("wanted"), F.col("ts").alias("at"), "wants")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def actions_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.counts_by_window(table(spark, sf_dir, "events"), "ts", "event_type")


@query("""WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM m)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS due, count(*) AS n FROM s GROUP BY user_id, burst""")
def debounced_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One send after each burst of changes, 30 minutes of quiet in these sparse events."""
    return claims.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("""SELECT event_type AS service, count(*) AS attempts, count(*) FILTER (value < 5 AND event_type <> 'error') AS successes, count(*) FILTER (NOT (value < 5 AND event_type <> 'error')) AS failures, count(*) FILTER (value < 5 AND event_type <> 'error') = 0 AS offline FROM events GROUP BY 1""")
def lookup_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.lookups(table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), ((F.col("value") < 5) & (F.col("event_type") != "error")).alias("ok")))


@query("""SELECT event_id, value < 10 AS found, ts AS at FROM events WHERE ts > (SELECT max(ts) FROM events) - CASE WHEN value < 10 THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END""")
def fresh_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", (F.col("value") < 10).alias("found"), F.col("ts").alias("at"))
    now = events.agg(F.max("at").alias("now"))
    return desk.fresh(events.join(now), F.col("now")).drop("now")


@query("SELECT user_id, list_sum(list(event_id ORDER BY ts DESC, event_id DESC)[:50])::BIGINT AS kept_sum, least(count(*), 50) AS kept FROM events GROUP BY 1")
def kept_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 notices of each key, by their number and the sum of their ids."""
    last = ordered.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", 50, "ts", "event_id")
    return last.groupBy("user_id").agg(F.sum("event_id").alias("kept_sum"), F.count(F.lit(1)).alias("kept"))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1")
def editors_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "user_id")


@query("""SELECT user_id, last(event_type ORDER BY ts, event_id) AS verdict, count(*) AS rounds FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def qa_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last verdict of a paper's checks and how many there were."""
    rounds = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    return rounds.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict"), F.count(F.lit(1)).alias("rounds"))
