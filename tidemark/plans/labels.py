"""Queries on selection, sets, contracts, scalar functions and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import rules, selection, sets
from tidemark.plans import views as V
from tidemark.plans.registry import hash_int, registry
from tidemark.sources.tables import checkpointed

QUERIES, ORACLES, query = registry()


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def reconcile_missing(spark, sf):
    docs, labels = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return sets.reconcile(docs, labels, "id").where("side = 'missing'").select("id")


@query("SELECT l.doc_id AS id FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL")
def reconcile_extra(spark, sf):
    docs, labels = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return sets.reconcile(docs, labels, "id").where("side = 'extra'").select("id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def dedup_last_wins(spark, sf):
    return sets.last_wins(V.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT id, 'known' AS subset FROM items WHERE known UNION ALL SELECT id, 'uncertain' FROM items WHERE NOT known")
def union_subsets(spark, sf):
    own = V.items(spark, sf)
    return sets.union_of({"known": own.where("known").select("id"), "uncertain": own.where("not known").select("id")})


@query("SELECT id, question_type FROM items WHERE question_type <> 'fr' UNION ALL SELECT id, 'new' FROM items WHERE id % 2 = 0")
def replace_by_subtype(spark, sf):
    own = V.items(spark, sf).select("id", "question_type")
    return sets.replaced(own, own.where("id % 2 = 0").withColumn("question_type", F.lit("new")), F.col("question_type") == "fr")


@query(""", a AS (SELECT id, id % 5 = 0 AS accepted, n_chars AS v FROM items WHERE id % 2 = 0), b AS (SELECT id, id % 3 = 0 AS accepted, n_chars + 1 AS v FROM items WHERE id % 3 <> 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN a.accepted WHEN a.id IS NULL THEN b.accepted WHEN a.accepted AND NOT b.accepted THEN a.accepted ELSE b.accepted END AS accepted,
  CASE WHEN b.id IS NULL THEN a.v WHEN a.id IS NULL THEN b.v WHEN a.accepted AND NOT b.accepted THEN a.v ELSE b.v END AS v FROM a FULL JOIN b ON a.id = b.id""")
def upsert_evidence(spark, sf):
    own = V.items(spark, sf)
    have = own.where("id % 2 = 0").select("id", (F.col("id") % 5 == 0).alias("accepted"), F.col("n_chars").alias("v"))
    come = own.where("id % 3 <> 1").select("id", (F.col("id") % 3 == 0).alias("accepted"), (F.col("n_chars") + 1).alias("v"))
    return sets.upsert(have, come, "id")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN replace(replace(text, 'the', 'THE'), 'THE ', 'the_') ELSE text END AS text, CASE WHEN id % 2 = 0 AND contains(text, 'the') THEN '1' || CASE WHEN contains(text, 'THE ') THEN ',2' ELSE '' END WHEN id % 2 = 0 AND contains(text, 'THE ') THEN '2' ELSE '' END AS trail FROM items")
def text_edits(spark, sf):
    own = V.items(spark, sf).select("id", "text")
    steps = F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.lit("the").alias("old"), F.lit("THE").alias("new")), F.struct(F.lit(2).cast("long").alias("seq"), F.lit("THE ").alias("old"), F.lit("the_").alias("new")))
    edits = own.where("id % 2 = 0").select("id", F.inline(steps))
    return sets.applied_edits(own, edits, "text").withColumn("trail", F.array_join(F.transform("trail", lambda x: x.cast("string")), ","))


PLACE = "row_number() OVER (PARTITION BY {by} ORDER BY sha256('{salt}:' || id))"


@query(f", r AS (SELECT id, question_type, known, {PLACE.format(by='question_type, known', salt='iaa')} AS place, count(*) OVER (PARTITION BY question_type, known) AS n FROM items) SELECT id, question_type, known, place FROM r WHERE place <= greatest(1, round_even(n * 0.4e0, 0)::BIGINT)")
def iaa_stratified_sample(spark, sf):
    return selection.stratified(V.items(spark, sf), ["question_type", "known"], 0.4).select("id", "question_type", "known", "place")


@query(f", b AS (SELECT *, query_time // 10 AS bin FROM items), r AS (SELECT id, bin, known, {PLACE.format(by='bin, known', salt='bin')} AS place FROM b), q AS (SELECT bin, least(count(*) FILTER (known), count(*) FILTER (NOT known)) AS quota FROM b GROUP BY bin) SELECT id, bin, known FROM r JOIN q USING (bin) WHERE place <= quota")
def balance_bins(spark, sf):
    return selection.balanced_bins(V.items(spark, sf), 10).select("id", "bin", "known")


@query(f", r AS (SELECT id, known = (id % 7 <> 0) AS agrees FROM items), p AS (SELECT id, agrees, {PLACE.format(by='agrees', salt='audit')} AS place, count(*) OVER (PARTITION BY agrees) AS n FROM r) SELECT id, agrees FROM p WHERE NOT agrees OR place <= round_even(n * 0.15e0, 0)")
def audit_sample(spark, sf):
    return selection.audit_sample(V.items(spark, sf), F.col("known") == (F.col("id") % 7 != 0), 0.15).select("id", "agrees")


@query(""", w AS (SELECT question_type, count(*) AS weight FROM items GROUP BY 1), e AS (SELECT *, 100 * weight / (SELECT sum(weight) FROM w)::DOUBLE AS e FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, weight DESC, question_type DESC) AS k, 100 - sum(floor(e)) OVER () AS spare FROM e) SELECT question_type, (floor(e) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def largest_remainder_quota(spark, sf):
    weights = V.items(spark, sf).groupBy("question_type").agg(F.count("*").alias("weight"))
    return selection.largest_remainder(weights, "question_type", "weight", 100)


@query(", g AS (SELECT episode_id, (row_number() OVER (ORDER BY episode_id) - 1) % 4 AS chunk FROM (SELECT DISTINCT episode_id FROM items)) SELECT id, episode_id, chunk FROM items JOIN g USING (episode_id)")
def episode_round_robin_chunks(spark, sf):
    return selection.round_robin_chunks(V.items(spark, sf), "episode_id", 4).select("id", "episode_id", "chunk")


@query("SELECT id, row_number() OVER (PARTITION BY episode_id ORDER BY known DESC, id) AS turn FROM items")
def interleaved_queue(spark, sf):
    return selection.interleaved(V.items(spark, sf), "episode_id", [F.desc("known"), F.col("id")]).select("id", "turn")


@query("SELECT id, (row_number() OVER (PARTITION BY question_type, known ORDER BY id) - 1) % 4 AS position FROM items")
def option_positions(spark, sf):
    return selection.balanced_positions(V.items(spark, sf), ["question_type", "known"], 4).select("id", "position")


@query("SELECT id, i, floor((i + 0.5e0) * (n_chars + 1) / 5)::BIGINT AS \"at\" FROM (SELECT id, n_chars, unnest(range(5)) AS i FROM items)")
def spread_selection(spark, sf):
    at = selection.spread_indices(F.col("n_chars") + 1, F.lit(5))
    return V.items(spark, sf).select("id", F.posexplode(at).alias("i", "at")).withColumn("i", F.col("i").cast("long"))


@query("SELECT id, i - 1 AS part, floor(i * n_chars / 6e0)::BIGINT - floor((i - 1) * n_chars / 6e0)::BIGINT AS size FROM (SELECT id, n_chars, unnest(range(1, 7)) AS i FROM items)")
def near_partition(spark, sf):
    return V.items(spark, sf).select("id", F.posexplode(selection.near_partition(F.col("n_chars"), F.lit(6))).alias("part", "size")).withColumn("part", F.col("part").cast("long"))


@query("SELECT episode_id, arg_max(id, (change_intensity, n_chars, id)) AS id FROM items GROUP BY 1")
def choose_by_score(spark, sf):
    return selection.best_by(V.items(spark, sf), "episode_id", "id", F.col("change_intensity"), F.col("n_chars"))


@query()
def greedy_coverage(spark, sf):
    cells = V.items(spark, sf).select("episode_id", F.concat_ws("|", "question_type", "known", F.floor(F.col("query_time") / 10)).alias("cell"))
    return selection.greedy_cover(cells, "episode_id", "cell", 5)


@query()
def greedy_visits(spark, sf):
    rows = V.frames(spark, sf).where("event_type = 'view'").select("episode", "seq", F.col("t").cast("double").alias("start"), (F.col("t") + F.floor(F.abs("value")) % 20).cast("double").alias("end"))
    return selection.folded(rows, "episode", ["start", "seq"], "episode long, seq long, start double, end double", selection.packed_visits(60.0, 10))


@query()
def answer_cycle(spark, sf):
    rows = V.items(spark, sf).select("id", "question_type", "episode_id", F.col("answer").cast("long").alias("answer"), X.hash_int(F.col("id").cast("string")).alias("h"))
    return selection.folded(rows, "question_type", ["h", "id"], "id long, question_type string, episode_id string, answer long", selection.capped_cycle(2, 20))


RULES = """, v AS (SELECT id, unnest(list_filter([CASE WHEN query_time >= 1 THEN NULL ELSE 'positive_time' END, CASE WHEN span_end >= 0 THEN NULL ELSE 'span_in_video' END, CASE WHEN span_end <= query_time THEN NULL ELSE 'causal' END,
  CASE WHEN length(text) >= 100 THEN NULL ELSE 'long_enough' END, CASE WHEN known OR answer = 3 THEN NULL ELSE 'abstention' END], lambda x: x IS NOT NULL)) AS rule FROM items)"""


def contract() -> dict:
    return {
        "positive_time": F.col("query_time") >= 1, "span_in_video": F.col("span_end") >= 0, "causal": F.col("span_end") <= F.col("query_time"),
        "long_enough": F.length("text") >= 100, "abstention": F.col("known") | (F.col("answer") == 3),
    }


@query(RULES + " SELECT id, rule FROM v")
def contract_violations(spark, sf):
    return rules.violations(V.items(spark, sf), contract())


@query(RULES + ", n AS (SELECT unnest(['positive_time', 'span_in_video', 'causal', 'long_enough', 'abstention']) AS rule) SELECT n.rule, count(v.id) AS failures, count(v.id) = 0 AS passed FROM n LEFT JOIN v ON n.rule = v.rule GROUP BY n.rule")
def contract_report(spark, sf):
    return rules.report(V.items(spark, sf), contract())


@query(RULES + " SELECT count(DISTINCT rule) = 0 AS passed, count(DISTINCT rule) AS failed FROM v")
def contract_gate(spark, sf):
    return rules.gate(rules.report(V.items(spark, sf), contract()))


@query(", s AS (SELECT seq, episode, t, t + value_end AS e FROM (SELECT *, seq % 5000 AS value_end FROM frames)), l AS (SELECT *, lag(e) OVER (PARTITION BY episode ORDER BY t, e) AS expected FROM s) SELECT seq, expected FROM l WHERE expected <> t")
def contiguity_gate(spark, sf):
    rows = V.frames(spark, sf).select("seq", "episode", "t", (F.col("t") + F.col("seq") % 5000).alias("e"))
    return rules.contiguous(rows, "episode", "t", "e").select("seq", "expected")


@query(", p AS (SELECT question_type, known, (row_number() OVER (PARTITION BY question_type, known ORDER BY id) - 1) % 4 AS position FROM items), c AS (SELECT question_type, known, position, count(*) AS n FROM p GROUP BY 1, 2, 3) SELECT question_type, known, max(n) - min(n) AS deviation, count(*) AS positions FROM c GROUP BY 1, 2")
def position_balance(spark, sf):
    return rules.balance_deviation(selection.balanced_positions(V.items(spark, sf), ["question_type", "known"], 4), ["question_type", "known"], "position")


@query(", d AS (SELECT seq, abs((t + seq % 7) - t) AS drift FROM frames WHERE seq % 9 <> 0) SELECT seq, drift FROM d WHERE drift > 4 UNION ALL SELECT seq, NULL FROM frames WHERE seq % 9 = 0")
def execution_drift(spark, sf):
    f = V.frames(spark, sf)
    return rules.execution_drift(f.select("seq", F.col("t").alias("start")), f.where("seq % 9 <> 0").select("seq", (F.col("t") + F.col("seq") % 7).alias("start")), "seq", 4).select("seq", "drift")


@query(", h AS (SELECT id, sha256(id || ':0') AS a, sha256(id || ':1') AS b, sha256(id || ':2') AS c FROM items) SELECT id, array_to_string(list_transform(list_sort([{'h': a, 'i': 0}, {'h': b, 'i': 1}, {'h': c, 'i': 2}]), lambda x: x.i), ',') AS permutation FROM h")
def option_permutation(spark, sf):
    order = X.option_permutation(F.col("id").cast("string"), F.lit(3))
    return V.items(spark, sf).select("id", F.array_join(F.transform(order, lambda x: x.cast("string")), ",").alias("permutation"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS n_distinct FROM documents")
def tokenise(spark, sf):
    t = X.tokens(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')) AS tokens_sha256 FROM documents")
def tokenise_full(spark, sf):
    """Number and digest of all tokens."""
    t = X.tokens(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


@query(""", t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<answer>' || chr((65 + conv_id % 5)::INTEGER) || '</answer>' WHEN 1 THEN chr((65 + conv_id % 5)::INTEGER) || '. ' || text WHEN 2 THEN 'the answer is ' || chr((97 + conv_id % 5)::INTEGER) ELSE text END AS x FROM conversations)
SELECT conv_id, turn, upper(coalesce(nullif(regexp_extract(x, '(?is)<answer>(?:.*?[^\\p{L}\\p{N}_])??([ABCD])(?:[^\\p{L}\\p{N}_].*?)?</answer>', 1), ''), nullif(regexp_extract(x, '(?i)(?:answer|答案|选项|choice)\\s*[:：]?\\s*\\(?([ABCD])\\)?', 1), ''),
  nullif(regexp_extract(x, '(?i)^\\s*\\(?([ABCD])\\)?(?:\\s|$|[。,.，])', 1), ''), nullif(regexp_extract(x, '(?i)(?:^|[^\\p{L}\\p{N}_])([ABCD])(?:[^\\p{L}\\p{N}_]|$)', 1), ''))) AS choice FROM t""")
def choice_extraction(spark, sf):
    c, t = F.col("conv_id"), F.col("turn") % 4
    letter = lambda base: F.char(c % 5 + base)
    x = F.when(t == 0, F.concat(F.lit("<answer>"), letter(65), F.lit("</answer>"))).when(t == 1, F.concat(letter(65), F.lit(". "), F.col("text"))).when(t == 2, F.concat(F.lit("the answer is "), letter(97))).otherwise(F.col("text"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", X.extract_choice(x, 4).alias("choice"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^A-Za-z]', '', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS words FROM pages")
def camel_words(spark, sf):
    from pyspark.sql import functions as F

    letters = F.regexp_replace("url", "[^A-Za-z]", "")
    return V.table(spark, sf, "pages").select("page_id", F.lower(F.regexp_replace(letters, "([a-z])([A-Z])", "$1 $2")).alias("words"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS q FROM documents")
def normalised_questions(spark, sf):
    """Digests of whole texts of all documents, in lower case and with white space collapsed."""
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(X.normalised_question(F.col("text")), 256).alias("q"))


@query()
def duplicate_questions(spark, sf):
    """Documents whose whole text, case folded and whitespace collapsed, others have too: how many have it and the smallest id. Null texts are none."""
    rows = V.table(spark, sf, "documents").where("text is not null").select("doc_id", X.question_digest("text").alias("question_sha256"))
    rows = checkpointed(rows)
    groups = rows.groupBy("question_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    return rows.join(groups, "question_sha256").select("doc_id", "question_sha256", "n", "first_id")


@query(f"SELECT doc_id, {hash_int('doc_id::VARCHAR')} AS h, 'video_' || substr(sha256(source || '/' || doc_id), 1, 16) AS name, {hash_int('doc_id::VARCHAR')} % 3 AS slot FROM documents")
def hashed_names(spark, sf):
    h = X.hash_int(F.col("doc_id").cast("string"))
    return V.table(spark, sf, "documents").select("doc_id", h.alias("h"), X.anonymous_id(F.concat_ws("/", "source", "doc_id")).alias("name"), (h % 3).alias("slot"))


@query("""SELECT doc_id, least(greatest(floor(n_chars / 7e0 + 1e-9), 0), 300)::BIGINT AS low, least(greatest(ceil(n_chars / 7e0 - 1e-9), 0), 300)::BIGINT AS high, ceil(n_chars / 7e0 * 20 - 1e-6)::BIGINT AS first_frame,
  least(greatest(n_chars // 2, 0), 500) AS middle, ((doc_id * 37 - n_chars + 180) % 360 + 360) % 360 - 180 AS turn, (round_even(n_chars / 28e0, 0) * 28)::BIGINT AS rounded FROM documents""")
def clock_arithmetic(spark, sf):
    n, t = F.col("n_chars"), F.col("n_chars") / 7
    return V.table(spark, sf, "documents").select(
        "doc_id", X.sample_floor(t, F.lit(300)).cast("long").alias("low"), X.sample_ceil(t, F.lit(300)).cast("long").alias("high"), X.frame_interval(t, t, 20.0)[0].alias("first_frame"),
        X.gap_midpoint(n, F.lit(0), F.lit(500)).cast("long").alias("middle"), X.wrap_angle(F.col("doc_id") * 37, n).alias("turn"), X.round_by_factor(n, 28).alias("rounded"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - l_suppkey % 50) * (l_quantity - l_suppkey % 50) + (l_partkey % 60 - l_orderkey % 40) * (l_partkey % 60 - l_orderkey % 40)), 4) AS d,
  (l_suppkey % 256) * 65536 + (l_partkey % 256) * 256 + l_orderkey % 256 AS colour FROM lineitem""")
def planar_geometry(spark, sf):
    a, b, c = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey")
    d = X.planar_distance(F.col("l_quantity"), b % 60, a % 50, c % 40)
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(d, 4).alias("d"), X.colour_key(a % 256, b % 256, c % 256).cast("long").alias("colour"))


@query("SELECT p_partkey, s_suppkey, round(abs(p_retailprice - s_acctbal), 2) AS gap FROM part JOIN supplier ON abs(p_retailprice - s_acctbal) <= 5")
def radius_join(spark, sf):
    """Pairs within a distance: both sides are bucketed by it, so the join has an equal key."""
    p, s = V.table(spark, sf, "part").select("p_partkey", "p_retailprice"), V.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    p = p.withColumn("b", F.explode(F.array(*[F.floor(F.col("p_retailprice") / 5) + k for k in (-1, 0, 1)])))
    both = p.join(s.withColumn("b", F.floor(F.col("s_acctbal") / 5)), "b").where("abs(p_retailprice - s_acctbal) <= 5")
    return both.select("p_partkey", "s_suppkey", F.round(F.abs(F.col("p_retailprice") - F.col("s_acctbal")), 2).alias("gap"))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey // 2 AS parent, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT node, parent // 2, depth + 1 FROM up WHERE parent > 7)
SELECT node, min(parent) AS room, max(depth) AS depth FROM up GROUP BY node""")
def room_of_node(spark, sf):
    """Containment followed upwards until the rooms (nodes up to 7). Node k lies in node k // 2, so its way up is as many halvings as the number has bits: one row's fold, without a recursion over the table."""
    nodes = V.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("node")).where("node > 1").distinct()
    start = F.struct(F.shiftright("node", 1).alias("room"), F.lit(1).alias("depth"))
    up = lambda a, _: F.when(a.room > 7, F.struct(F.shiftright(a.room, 1).alias("room"), (a.depth + 1).alias("depth"))).otherwise(a)
    return nodes.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.length(F.bin("node"))), start, up)).select("node", "a.room", "a.depth")
