"""Queries of evaluation and training: hit rates, probes, step metrics, separation checks, masked losses, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import tokens
from strandline.operators import scoring, sketches
from strandline.operators.algorithms import build_algorithm

from .relational import query
from .views import ROW_PLACE, annotations, metadata, placed_table, plasmid_tokens, registry, sequences, table

_EOS = "(contains(text, 'e') AND length(text) % 3 = 0)"


@query("SELECT sum(n)::BIGINT AS total, max(n) AS largest, min(n) AS smallest FROM (SELECT plasmid_id, count(*) AS n FROM ann GROUP BY 1)")
def agg_count_extremes(spark, d):
    n = annotations(spark, d).groupBy("plasmid_id").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


@query("SELECT token, sseqid, min(feature) AS feature, min(seq_len) AS seq_len, count(*) AS n_annotations, count(DISTINCT plasmid_id) AS n_plasmids FROM ann JOIN reg USING (sseqid) GROUP BY 1, 2")
def agg_registry_sequences(spark, d):
    """The second level of the registry: one row per token and sequence."""
    used = annotations(spark, d).groupBy("sseqid", "plasmid_id").agg(F.count("*").alias("n"))
    used = used.groupBy("sseqid").agg(F.sum("n").alias("n_annotations"), F.count("*").alias("n_plasmids"))
    return registry(spark, d).join(used, "sseqid").select("token", "sseqid", "feature", "seq_len", "n_annotations", "n_plasmids")


@query("SELECT token, arg_max(sseqid, coalesce(nullif(CASE WHEN sseqid % 4 = 0 THEN 0 ELSE seq_len END, 0), sseqid % 7) * 1000000 - sseqid) AS sseqid, max(coalesce(nullif(CASE WHEN sseqid % 4 = 0 THEN 0 ELSE seq_len END, 0), sseqid % 7)) AS length FROM reg GROUP BY 1")
def agg_longest_variant(spark, d):
    """The longest variant of each token: by nucleotides, else by amino acids; ties go to the smaller id."""
    dna_len, protein_len = F.when(F.col("sseqid") % 4 == 0, 0).otherwise(F.col("seq_len")), F.col("sseqid") % 7
    size = F.coalesce(F.nullif(dna_len, F.lit(0)), protein_len)
    return registry(spark, d).groupBy("token").agg(F.max_by("sseqid", F.struct(size.alias("n"), (-F.col("sseqid")).alias("i"))).alias("sseqid"), F.max(size).alias("length"))


@query(f", p AS (SELECT plasmid_id, count(*) AS n, count(*) FILTER (WHERE percmatch >= 50) AS f FROM ann GROUP BY 1), q AS (SELECT p.*, length(text) AS size, {_EOS} AS eos FROM p JOIN documents ON doc_id = plasmid_id) SELECT round(avg(f / n), 8) AS macro, round(sum(f) / sum(n), 8) AS micro, round(avg(eos::INT), 8) AS eos_rate, round(avg(size), 6) AS mean_size, round(quantile_cont(size, 0.5), 4) AS median_size, count(*) FILTER (WHERE f = n) AS perfect FROM q")
def agg_prompt_summary(spark, d):
    """Macro and micro hit rates, share of finished sequences, mean and median length, perfect prompts."""
    per = annotations(spark, d).groupBy("plasmid_id").agg(F.count("*").alias("n"), F.count_if(F.col("percmatch") >= 50).alias("f"))
    text = table(spark, d, "documents").select(F.col("doc_id").alias("plasmid_id"), F.length("text").alias("size"), (F.contains("text", F.lit("e")) & (F.length("text") % 3 == 0)).alias("eos"))
    one = per.join(text, "plasmid_id")
    whole = one.agg(F.round(F.avg(F.col("f") / F.col("n")), 8).alias("macro"), F.round(F.sum("f") / F.sum("n"), 8).alias("micro"), F.round(F.avg(F.col("eos").cast("int")), 8).alias("eos_rate"), F.round(F.avg("size"), 6).alias("mean_size"), F.count_if(F.col("f") == F.col("n")).alias("perfect"))
    return whole.crossJoin(F.broadcast(scoring.quantiles(one, "size", {"median_size": 0.5}))).select("macro", "micro", "eos_rate", "mean_size", "median_size", "perfect")  # one row each


@query(", w AS (SELECT plasmid_id, tokens AS want FROM ptok), g AS (SELECT plasmid_id, list_sort(list_distinct(list(token))) AS got FROM ann JOIN reg USING (sseqid) WHERE percmatch >= 60 GROUP BY 1), c AS (SELECT len(list_intersect(want, coalesce(got, []))) AS tp, len(want) AS n, len(coalesce(got, [])) AS m FROM w LEFT JOIN g USING (plasmid_id)) SELECT sum(tp)::BIGINT AS tp, sum(n - tp)::BIGINT AS fn, sum(m - tp)::BIGINT AS fp, round(sum(tp) / sum(m), 8) AS prec, round(sum(tp) / sum(n), 8) AS recall FROM c")
def agg_confusion_counts(spark, d):
    """True and false positives and false negatives of found against wanted tokens."""
    got = annotations(spark, d).where("percmatch >= 60").join(registry(spark, d).select("sseqid", "token"), "sseqid").groupBy("plasmid_id").agg(F.collect_set("token").alias("got"))
    both = plasmid_tokens(spark, d).join(got, "plasmid_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    both = both.select(F.size(F.array_intersect("tokens", "got")).alias("tp"), F.size("tokens").alias("n"), F.size("got").alias("m"))
    return both.agg(F.sum("tp").alias("tp"), F.sum(F.col("n") - F.col("tp")).alias("fn"), F.sum(F.col("m") - F.col("tp")).alias("fp"), F.round(F.sum("tp") / F.sum("m"), 8).alias("prec"), F.round(F.sum("tp") / F.sum("n"), 8).alias("recall"))


@query("SELECT token, count(*) AS attempts, list(plasmid_id ORDER BY plasmid_id, ln) FILTER (WHERE percmatch < 4) AS failures FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def agg_token_failures(spark, d):
    """Attempts of each token, and the plasmids in which it failed."""
    failed = F.when(F.col("percmatch") < 4, F.struct("plasmid_id", "ln"))
    out = annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("token").agg(F.count("*").alias("attempts"), F.array_sort(F.collect_list(failed)).alias("x"))
    return out.select("token", "attempts", F.when(F.size("x") > 0, F.transform("x", lambda r: r["plasmid_id"])).alias("failures"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY 1")
def agg_describe(spark, d):
    """Count, mean, deviation, range and exact quartiles of each group, picked by rank."""
    e = table(spark, d, "events").select("event_type", "value")
    v = F.col("value")
    plain = e.groupBy("event_type").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    q = scoring.quantiles(e, "value", {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["event_type"])
    return plain.join(q, "event_type").select("event_type", "n", "mean", "sd", "low", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3")], "high")


_SEP = "x AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(n_chars) FILTER (WHERE quality = 1) AS a, avg(n_chars) FILTER (WHERE quality = 0) AS b, quantile_cont(n_chars, 0.25) FILTER (WHERE quality = 1) AS a1, quantile_cont(n_chars, 0.75) FILTER (WHERE quality = 1) AS a3, quantile_cont(n_chars, 0.25) FILTER (WHERE quality = 0) AS b1, quantile_cont(n_chars, 0.75) FILTER (WHERE quality = 0) AS b3, max(n_chars) - min(n_chars) AS span FROM x), u AS (SELECT avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0::DOUBLE WHEN p.n_chars = q.n_chars THEN 0.5::DOUBLE ELSE 0 END) AS auroc FROM x p JOIN x q ON p.quality = 1 AND q.quality = 0)"


@query(f", {_SEP} SELECT round(a - b, 6) AS gap, round(a / greatest(b, 1e-8), 6) AS ratio, greatest(least(a3, b3) - greatest(a1, b1), 0) AS overlap, round(auroc, 8) AS auroc, a / greatest(b, 1e-8) > 3 AS ratio_ok, a / greatest(b, 1e-8) > 2 AS shuffled_ok, a1 > b3 AS quartiles_ok, auroc > 0.95 AS auroc_ok, span > 0.5 AS range_ok FROM m, u")
def agg_separation_checks(spark, d):
    """Gap, ratio, overlap of the quartile ranges and AUROC of two groups, and which checks they pass (ratio 3 against random, 2 against shuffled ones)."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", "n_chars")
    mean = lambda q: F.avg(F.when(F.col("quality") == q, F.col("n_chars")))
    m = x.agg(mean(1).alias("a"), mean(0).alias("b"), (F.max("n_chars") - F.min("n_chars")).alias("span")).crossJoin(F.broadcast(scoring.auroc(x, "n_chars", "quality")))  # one row
    for name, q in (("a", 1), ("b", 0)):
        m = m.crossJoin(F.broadcast(scoring.quantiles(x.where(F.col("quality") == q), "n_chars", {f"{name}1": 0.25, f"{name}3": 0.75})))  # one row
    ratio = F.col("a") / F.greatest("b", F.lit(1e-8))
    overlap = F.greatest(F.least("a3", "b3") - F.greatest("a1", "b1"), F.lit(0.0))
    checks = [(ratio > 3).alias("ratio_ok"), (ratio > 2).alias("shuffled_ok"), (F.col("a1") > F.col("b3")).alias("quartiles_ok"), (F.col("auroc") > 0.95).alias("auroc_ok"), (F.col("span") > 0.5).alias("range_ok")]
    return m.select(F.round(F.col("a") - F.col("b"), 6).alias("gap"), F.round(ratio, 6).alias("ratio"), overlap.alias("overlap"), F.round("auroc", 8).alias("auroc"), *checks)


@query()
def agg_profile_sketch(spark, d):
    """Approximate percentiles of each type of event, one alone and several at once, from sketches of each day that are merged."""
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    daily = sketches.sketches(e, "value", ["event_type", "day"])
    whole = sketches.merged(daily, ["event_type"])
    return whole.select("event_type", F.kll_sketch_get_n_double("sketch").alias("n"), sketches.quantile(F.col("sketch"), 0.5).alias("median"), sketches.quantile(F.col("sketch"), [0.25, 0.75, 0.9, 0.95, 0.99]).alias("percentiles"))


@query("SELECT conv_id, turn, CASE WHEN sd > 1e-8 THEN round((r - m) / sd, 6) ELSE 0 END AS by_group, round((r - am) / (asd + 1e-8), 6) AS by_all FROM (SELECT conv_id, turn, length(text)::DOUBLE AS r, avg(length(text)) OVER w AS m, coalesce(stddev_samp(length(text)) OVER w, 0) AS sd, avg(length(text)) OVER () AS am, stddev_samp(length(text)) OVER () AS asd FROM conversations WINDOW w AS (PARTITION BY conv_id))")
def agg_advantages(spark, d):
    """Advantages of rewards by both registered algorithms."""
    r = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("reward"))
    one = build_algorithm("grpo", group="conv_id").advantages(r).withColumnRenamed("advantage", "by_group")
    return build_algorithm("ppo").advantages(one).select("conv_id", "turn", F.round("by_group", 6).alias("by_group"), F.round("advantage", 6).alias("by_all"))


@query("SELECT decile, mean, coalesce(mean >= lag(mean) OVER (ORDER BY decile), true) AS rises FROM (SELECT floor(pident - 90)::INT AS decile, round(avg(percmatch), 6) AS mean FROM ann GROUP BY 1)")
def agg_monotone_check(spark, d):
    """Whether the mean score of each level is no lower than that of the level before."""
    m = annotations(spark, d).groupBy(F.floor(F.col("pident") - 90).cast("int").alias("decile")).agg(F.round(F.avg("percmatch"), 6).alias("mean"))
    return m.select("decile", "mean", F.coalesce(F.col("mean") >= F.lag("mean").over(Window.partitionBy().orderBy("decile")), F.lit(True)).alias("rises"))  # a row a level


# The labels, logits and masks of the next queries come from the embeddings: 64 logits, of which those of the prompt (the first vec_id % 9) are masked.
_TOK = "tk AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), tm AS (SELECT *, CASE WHEN pos < vec_id % 9 THEN -100 ELSE (pos * 7 + vec_id) % 5 END AS y, floor(abs(x) * 1000)::BIGINT % 5 AS guess FROM tk)"


def _tokens(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    y = F.when(F.col("pos") < F.col("vec_id") % 9, F.lit(-100)).otherwise((F.col("pos") * 7 + F.col("vec_id")) % 5)
    return t.withColumn("y", y).withColumn("guess", F.floor(F.abs("x") * 1000) % 5)


# Predictions of the next query: each embedding is the logits of one place of a sequence of eight; the label of a place is that of its row, each fifth masked.
@query(", p AS (SELECT vec_id // 8 AS seq, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS z, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS y FROM embeddings), n AS (SELECT seq, z, lead(y) OVER (PARTITION BY seq ORDER BY vec_id) AS y FROM p), c AS (SELECT seq, (list_position(z, list_max(z)) - 1 = y)::INT AS good, ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[y + 1] AS ce FROM n WHERE y IS NOT NULL AND y <> -100) SELECT seq, count(*) AS n, round(avg(good), 8) AS accuracy, round(avg(ce), 6) AS loss, round(exp(least(avg(ce), 20)), 4) AS perplexity FROM c GROUP BY 1")
def agg_label_accuracy(spark, d):
    """Accuracy, cross-entropy and perplexity of each sequence: a place predicts the label of the next one, unless that is masked (-100)."""
    y = F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label"))
    p = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq"), "vec_id", "embedding", y.alias("own"))
    p = p.withColumn("y", F.lead("own").over(Window.partitionBy("seq").orderBy("vec_id"))).where("y is not null and y <> -100")  # eight rows
    top, loss = scoring.label_loss(F.transform("embedding", lambda v: v.cast("double")), F.col("y"))
    out = p.select("seq", (top == F.col("y")).cast("int").alias("good"), loss.alias("ce")).groupBy("seq").agg(F.count("*").alias("n"), F.avg("good").alias("g"), F.avg("ce").alias("ce"))
    return out.select("seq", "n", F.round("g", 8).alias("accuracy"), F.round("ce", 6).alias("loss"), F.round(scoring.perplexity(F.col("ce")), 4).alias("perplexity"))


# Log-probabilities of tokens: the policy's, the old policy's and the reference's.
_LP = "lp AS (SELECT vec_id, pos, -abs(x) AS cur, -abs(x) * (0.9::DOUBLE + (pos % 5) / 20.0::DOUBLE) AS old, -abs(x) * (1.1::DOUBLE - (pos % 3) / 15.0::DOUBLE) AS ref, (vec_id % 11 - 5) / 5.0::DOUBLE AS adv, CASE WHEN y = -100 OR vec_id % 50 = 0 THEN 0 ELSE 1 END AS m FROM tm), sq AS (SELECT vec_id, any_value(adv) AS adv, greatest(sum(m), 1) AS n, sum(m * cur) AS lp, sum(m * least(exp(cur - old) * adv, least(greatest(exp(cur - old), 0.8::DOUBLE), 1.2::DOUBLE) * adv)) AS surr, sum(m * (exp(ref - cur) - (ref - cur) - 1)) AS kl, sum(m * ref) AS ref FROM lp GROUP BY 1)"


def _sequences(spark, d):
    """Per sequence: advantage, and the terms of the losses summed over the mask, whose count is 1 at least."""
    t = _tokens(spark, d)
    cur = -F.abs("x")
    old, ref = cur * (F.lit(0.9) + F.col("pos") % 5 / F.lit(20.0)), cur * (F.lit(1.1) - F.col("pos") % 3 / F.lit(15.0))
    adv = (F.col("vec_id") % 11 - 5) / F.lit(5.0)
    m = F.when((F.col("y") == -100) | (F.col("vec_id") % 50 == 0), 0).otherwise(1)
    rows = t.select("vec_id", cur.alias("cur"), old.alias("old"), ref.alias("ref"), adv.alias("adv"), m.alias("m"))
    return rows.groupBy("vec_id").agg(F.first("adv").alias("adv"), *scoring.masked_terms("cur", "old", "ref", "adv", "m"))


@query(f", {_TOK}, {_LP} SELECT round(-avg(adv * lp / n), 6) AS reinforce, round(avg(-surr / n - 0.01::DOUBLE * (-lp / n)), 6) AS ppo, round(avg(-surr / n + 0.1::DOUBLE * kl / n), 6) AS grpo FROM sq")
def loss_masked(spark, d):
    """The three policy losses: means over masked tokens of each sequence (of 1 at least), then over sequences."""
    return _sequences(spark, d).agg(*[F.round(scoring.LOSSES[name](), 6).alias(name) for name in ("reinforce", "ppo", "grpo")])


@query(f", {_TOK}, {_LP}, p AS (SELECT vec_id // 2 AS pair, max(lp / n) FILTER (WHERE vec_id % 2 = 0) AS w, max(lp / n) FILTER (WHERE vec_id % 2 = 1) AS l, max(ref / n) FILTER (WHERE vec_id % 2 = 0) AS rw, max(ref / n) FILTER (WHERE vec_id % 2 = 1) AS rl FROM sq GROUP BY 1) SELECT pair, round(ln(1 + exp(-0.1::DOUBLE * ((w - rw) - (l - rl)))), 6) AS loss FROM p WHERE w IS NOT NULL AND l IS NOT NULL")
def loss_dpo_reference(spark, d):
    """Preference loss of pairs of a chosen and a rejected sequence against a reference model, by mean log-probabilities over the mask."""
    chosen = F.col("vec_id") % 2 == 0
    part = lambda c, which: F.max(F.when(which, F.col(c) / F.col("n")))
    p = _sequences(spark, d).groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(part("lp", chosen).alias("w"), part("lp", ~chosen).alias("l"), part("ref", chosen).alias("rw"), part("ref", ~chosen).alias("rl"))
    return p.where("w is not null and l is not null").select("pair", F.round(scoring.pair_loss(F.col("w") - F.col("rw"), F.col("l") - F.col("rl")), 6).alias("loss"))


_ROUTE = "pr AS (SELECT vec_id, label, pos, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM tk), tp AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS r FROM pr)"


def _routes(spark, d, k: int = 2):
    """vec_id, label, expert, weight (renormalised) of each row's k best experts."""
    p = scoring.softmax(F.transform("embedding", lambda x: x.cast("double")))
    t = table(spark, d, "embeddings").select("vec_id", "label", p.alias("p"))
    return t, t.select("vec_id", "label", F.explode(scoring.top_k(F.col("p"), k)).alias("x")).select("vec_id", "label", F.col("x.i").alias("expert"), F.col("x.w").alias("weight"))


@query(f", {_TOK}, {_ROUTE} SELECT vec_id, pos::INT AS expert, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS weight FROM tp WHERE r <= 2")
def topk_renormalised(spark, d):
    """The two best experts of each row, their weights summing to 1."""
    return _routes(spark, d)[1].select("vec_id", "expert", F.round("weight", 6).alias("weight"))


@query(f", {_TOK}, {_ROUTE}, f AS (SELECT pos, count(*) FILTER (WHERE r <= 2) / (2 * count(DISTINCT vec_id)) AS f, avg(p) AS q FROM tp GROUP BY 1) SELECT round(64 * sum(f * q), 8) AS loss FROM f")
def router_load_balance(spark, d):
    """Experts times the sum of each one's share of routes and mean probability."""
    t, routes = _routes(spark, d)
    q = t.select(F.posexplode("p").alias("expert", "p")).groupBy("expert").agg(F.avg("p").alias("q"), F.count("*").alias("n"))
    f = routes.groupBy("expert").agg(F.count("*").alias("hits"))
    return q.join(f, "expert", "left").agg(F.round(64 * F.sum(F.coalesce("hits", F.lit(0)) / (2 * F.col("n")) * F.col("q")), 8).alias("loss"))


@query(f", {_TOK}, {_ROUTE}, l AS (SELECT vec_id % 4 AS layer, CASE WHEN label % 3 = 0 THEN 'structural' WHEN label % 3 = 1 THEN 'annotation' ELSE 'dna' END AS kind, pos AS expert FROM tp WHERE r <= 2) SELECT layer, kind, expert::INT AS expert, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY layer), 8) AS layer_share, round(count(*) / sum(count(*)) OVER (PARTITION BY layer, kind), 8) AS kind_share, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM l GROUP BY 1, 2, 3")
def agg_router_layers(spark, d):
    """Routes per layer, kind of token and expert, with shares of the layer, of the kind within it and of all."""
    kind = F.when(F.col("label") % 3 == 0, "structural").when(F.col("label") % 3 == 1, "annotation").otherwise("dna")
    n = _routes(spark, d)[1].groupBy((F.col("vec_id") % 4).alias("layer"), kind.alias("kind"), "expert").agg(F.count("*").alias("n"))
    share = lambda *by: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 8)  # noqa: E731  a row a layer, kind and expert
    return n.select("layer", "kind", "expert", "n", share("layer").alias("layer_share"), share("layer", "kind").alias("kind_share"), share().alias("share"))


@query("SELECT user_id, CASE WHEN event_type = 'error' THEN 'peak_memory' ELSE event_type END AS stat, CASE WHEN event_type = 'error' THEN max(value) ELSE round(avg(value), 6) END AS value FROM events GROUP BY user_id, event_type")
def agg_actor_stats(spark, d):
    """Statistics of actors: the largest of those named peak, the mean of the others."""
    name = F.when(F.col("event_type") == "error", "peak_memory").otherwise(F.col("event_type"))
    s = table(spark, d, "events").select("user_id", name.alias("stat"), "value").groupBy("user_id", "stat").agg(F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))
    return s.select("user_id", "stat", F.when(F.contains("stat", F.lit("peak")), F.col("hi")).otherwise(F.col("mean")).alias("value"))


@query(", r AS (SELECT conv_id, turn, length(text) AS r, turn * 10 + length(text) AS ms FROM conversations), g AS (SELECT conv_id % 8 AS step, conv_id, max(r) AS best, min(r) AS worst FROM r GROUP BY 1, 2), s AS (SELECT conv_id % 8 AS step, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, min(r) AS low, max(r) AS high, round(sum(r) * 1000.0::DOUBLE / sum(ms), 6) AS per_second, round(sum(turn * 10) / sum(ms), 8) AS time_share FROM r GROUP BY 1) SELECT s.*, b.best, b.worst FROM s JOIN (SELECT step, round(avg(best), 6) AS best, round(avg(worst), 6) AS worst FROM g GROUP BY 1) b USING (step)")
def agg_step_metrics(spark, d):
    """Per step: rewards, the mean of the groups' best and worst, tokens a second and the share of time of one phase."""
    r, ms = F.length("text").cast("long"), F.col("turn") * 10 + F.length("text")
    g = table(spark, d, "conversations").groupBy((F.col("conv_id") % 8).alias("step"), "conv_id").agg(F.sum(r).alias("s"), F.sum((r * r).cast("double")).alias("ss"), F.count("*").alias("n"), F.max(r).alias("b"), F.min(r).alias("w"), F.sum(ms).alias("ms"), F.sum(F.col("turn") * 10).alias("t"))
    n, s = F.sum("n"), F.sum("s")
    sd = F.when(n > 1, F.sqrt((F.sum("ss") - s * s / n) / (n - 1)))
    return g.groupBy("step").agg(F.round(s / n, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.min("w").alias("low"), F.max("b").alias("high"), F.round(s * F.lit(1000.0) / F.sum("ms"), 6).alias("per_second"), F.round(F.sum("t") / F.sum("ms"), 8).alias("time_share"), F.round(F.avg("b"), 6).alias("best"), F.round(F.avg("w"), 6).alias("worst"))


@query(", c AS (SELECT token, plasmid_id, row_number() OVER (PARTITION BY token ORDER BY md5(plasmid_id::VARCHAR), plasmid_id) AS r FROM (SELECT DISTINCT token, plasmid_id FROM ann JOIN reg USING (sseqid))) SELECT c.token, c.plasmid_id, coalesce(list_contains(tokens, c.token), false) AS hit FROM c LEFT JOIN ptok USING (plasmid_id) WHERE r = 1")
def agg_probe_hits(spark, d):
    """One candidate per token: whether the token is among those found in it."""
    pairs = annotations(spark, d).join(registry(spark, d), "sseqid").select("token", "plasmid_id").distinct()
    chosen = pairs.groupBy("token").agg(F.min_by("plasmid_id", F.struct(F.md5(F.col("plasmid_id").cast("string").cast("binary")).alias("h"), "plasmid_id")).alias("plasmid_id"))
    return chosen.join(plasmid_tokens(spark, d), "plasmid_id", "left").select("token", "plasmid_id", F.coalesce(F.array_contains("tokens", F.col("token")), F.lit(False)).alias("hit"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_seconds, round(count(*) * 128 / quantile_cont(value, 0.5), 4) AS per_second FROM events GROUP BY 1")
def agg_benchmark_summary(spark, d):
    """Median of timed runs and the throughput that it means."""
    e = table(spark, d, "events").select("event_type", "value")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(scoring.quantiles(e, "value", {"q": 0.5}, ["event_type"]), "event_type").select("event_type", F.round("q", 6).alias("median_seconds"), F.round(F.col("n") * 128 / F.col("q"), 4).alias("per_second"))


@query(", p AS (SELECT plasmid_id, array_to_string(tokens, '') AS prompt, len(tokens) AS n FROM ptok) SELECT plasmid_id, prompt FROM p LEFT JOIN seqs USING (plasmid_id) QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY n DESC, length(sequence) ASC NULLS LAST, plasmid_id) <= 50")
def window_prompt_cap_length(spark, d):
    """At most 50 plasmids of a prompt: of most tokens, then of the shortest sequences."""
    p = plasmid_tokens(spark, d).select("plasmid_id", F.array_join("tokens", "").alias("prompt"), F.size("tokens").alias("n"))
    p = p.join(sequences(spark, d).select("plasmid_id", F.length("sequence").alias("size")), "plasmid_id", "left")
    w = Window.partitionBy("prompt").orderBy(F.desc("n"), F.col("size").asc_nulls_last(), "plasmid_id")
    return p.withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("plasmid_id", "prompt")


@query(", s AS (SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS step, sum(round(value * 100)::BIGINT) / (100.0::DOUBLE * count(*)) AS mu, coalesce(stddev_samp(value), 0) AS sd, max(value) AS top, min(value) AS low FROM events GROUP BY 1, 2), e AS (SELECT user_id, list(mu ORDER BY step) AS mu, list({'step': step, 'sd': sd, 'top': top, 'low': low} ORDER BY step) AS v FROM s GROUP BY 1), b AS (SELECT user_id, unnest(range(1, len(v) + 1)) AS i, mu, v FROM e), c AS (SELECT user_id, v[i] AS x, list_reduce(mu[1:i], lambda b, x: 0.95::DOUBLE * b + 0.05::DOUBLE * x) AS base FROM b) SELECT user_id, x.step AS step, round(base + 1e-9, 6) AS baseline, round((x.top - base) / greatest(x.sd, 0.1::DOUBLE) + 1e-7, 4) + 0.0::DOUBLE AS best_advantage, round((x.low - base) / greatest(x.sd, 0.1::DOUBLE) + 1e-7, 4) + 0.0::DOUBLE AS worst_advantage FROM c")
def window_ema_advantage(spark, d):
    """The moving baseline after every step of each user, and the advantage of the step's best and worst reward over it."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    s = table(spark, d, "events").groupBy("user_id", day.alias("step")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / (F.lit(100.0) * F.count("*"))).alias("mu"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.max("value").alias("top"), F.min("value").alias("low"))
    # means of few rewards end in a digit 5 often; what is added before rounding makes such halves go up, however the last bit falls
    gain = lambda reward: F.round(scoring.step_advantage(F.col(reward), F.col("baseline"), F.col("sd")) + 1e-7, 4) + F.lit(0.0)
    return scoring.moving_baseline(s, ["user_id"], ["step"], "mu").select("user_id", "step", F.round(F.col("baseline") + 1e-9, 6).alias("baseline"), gain("top").alias("best_advantage"), gain("low").alias("worst_advantage"))


@query(f", q AS (SELECT plasmid_id, ln, percmatch * pident AS s FROM ann), b AS (SELECT plasmid_id, max(s) AS best, avg(s) AS mean, count(*) AS n FROM q GROUP BY 1) SELECT n, count(*) AS prompts, round(avg(best), 6) AS best_of_n, round(avg(mean), 6) AS mean FROM b GROUP BY 1")
def topk_best_of_n_mean(spark, d):
    """Mean over prompts of the best of N candidates, and of their mean, by N."""
    s = F.col("percmatch") * F.col("pident")
    b = annotations(spark, d).groupBy("plasmid_id").agg(F.max(s).alias("best"), F.avg(s).alias("mean"), F.count("*").alias("n"))
    return b.groupBy("n").agg(F.count("*").alias("prompts"), F.round(F.avg("best"), 6).alias("best_of_n"), F.round(F.avg("mean"), 6).alias("mean"))


@query("(SELECT 'best' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) UNION ALL (SELECT 'worst', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25)")
def topk_worst_and_best(spark, d):
    """The 25 best and the 25 worst orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    best = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select(F.lit("best").alias("side"), "*")
    return best.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(25).select(F.lit("worst").alias("side"), "*"))


@query(", e AS (SELECT doc_id, e AS epoch, md5(doc_id::VARCHAR || '-' || e) AS h FROM documents, (VALUES (0), (1), (2)) v(e)), r AS (SELECT doc_id, epoch, row_number() OVER (ORDER BY epoch, h, doc_id) - 1 AS rn FROM e) SELECT epoch::INT AS epoch, doc_id, rn // 48 AS batch FROM r")
def batch_cycle(spark, d):
    """Three epochs, each in its own shuffled order, cut into batches that may span two epochs."""
    from strandline.operators.order import number_rows

    e = table(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("epoch"))
    e = e.withColumn("h", F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("epoch").cast("string")).cast("binary")))
    return number_rows(e, ["epoch", "h", "doc_id"], "rn").select("epoch", "doc_id", F.floor(F.col("rn") / 48).alias("batch"))


@query(", b AS (SELECT id, trim(json_extract_string(cloning, '$.backbone')) AS backbone FROM meta), top AS (SELECT backbone FROM b GROUP BY 1 ORDER BY count(*) DESC, backbone LIMIT 20) SELECT id, CASE WHEN top.backbone IS NOT NULL THEN '<BB_' || replace(replace(replace(upper(b.backbone), ' ', '_'), '/', '_'), '.', '') || '>' END AS token FROM b LEFT JOIN top USING (backbone)")
def topn_backbone_or_null(spark, d):
    """The token of the 20 most frequent backbones; null for all others."""
    b = metadata(spark, d).select("id", F.trim(F.get_json_object("cloning", "$.backbone")).alias("backbone"))
    top = b.groupBy("backbone").count().orderBy(F.desc("count"), "backbone").limit(20).select("backbone", F.lit(True).alias("top"))
    return b.join(F.broadcast(top), "backbone", "left").select("id", F.when(F.col("top"), F.concat(F.lit("<BB_"), tokens.clean_name(F.col("backbone")), F.lit(">"))).alias("token"))  # 20 rows


@query(", q AS (SELECT plasmid_id, category, token, 0.4::DOUBLE * pident / 100 + 0.35::DOUBLE * least(percmatch, 100) / 100 + 0.25::DOUBLE * least(percmatch / 100 / 1.5::DOUBLE, 1) AS q, percmatch >= 50 AS f FROM ann JOIN reg USING (sseqid)), e AS (SELECT plasmid_id, token, count(*) AS n FROM q WHERE category = 'ELEM' GROUP BY 1, 2), x AS (SELECT plasmid_id, sum(n - 1) AS extra FROM e GROUP BY 1) SELECT plasmid_id, round(pow(exp(avg(ln(greatest(q, 1e-6)))), 2) * (0.5::DOUBLE + 0.5::DOUBLE * (count(*) FILTER (WHERE f) / count(*))) * pow(0.85::DOUBLE, greatest(count(*) FILTER (WHERE category = 'ORI') - 1, 0)) * pow(0.95::DOUBLE, coalesce(any_value(extra), 0)), 8) AS score FROM q LEFT JOIN x USING (plasmid_id) GROUP BY 1")
def score_demo(spark, d):
    """Squared geometric mean, times recall, times 0.85 an excess origin and 0.95 a repeat of each element."""
    q = annotations(spark, d).join(registry(spark, d), "sseqid").select("plasmid_id", "category", "token", scoring.token_quality(F.col("pident"), F.least("percmatch", F.lit(100.0)), F.col("percmatch") / 100).alias("q"), (F.col("percmatch") >= 50).alias("f"))
    extra = q.where("category = 'ELEM'").groupBy("plasmid_id", "token").agg((F.count("*") - 1).alias("n")).groupBy("plasmid_id").agg(F.sum("n").alias("extra"))
    _, _, total = scoring.composite("q", F.count_if("f"), F.count("*"))
    s = q.groupBy("plasmid_id").agg(total.alias("s"), F.greatest(F.count_if(F.col("category") == "ORI") - 1, F.lit(0)).alias("o"))
    return s.join(extra, "plasmid_id", "left").select("plasmid_id", F.round(F.col("s") * F.pow(F.lit(0.85), "o") * F.pow(F.lit(0.95), F.coalesce("extra", F.lit(0))), 8).alias("score"))


@query("SELECT plasmid_id, tokens IS NOT NULL AND len(tokens) > 0 AS hard FROM ptok WHERE len(tokens) > 0")
def filter_hard_prompts(spark, d):
    """Prompts with hard tokens, told by whichever column there is."""
    from strandline.sources.files import has_hard_tokens

    p = plasmid_tokens(spark, d).withColumnRenamed("tokens", "reward_motifs")
    return p.where(has_hard_tokens(p)).select("plasmid_id", has_hard_tokens(p).alias("hard"))


@query("SELECT plasmid_id, CASE WHEN length(sequence) < 20 THEN 0 ELSE length(sequence) END AS scored, CASE WHEN length(sequence) < 100 THEN 0 ELSE length(sequence) END AS annotated, length(sequence) >= 10 AS usable_motif FROM seqs")
def filter_min_lengths(spark, d):
    """Lengths below the least usable ones count as none: 20 to score, 100 to annotate, 10 for a motif."""
    n = F.length("sequence").cast("long")
    at_least = lambda k: F.when(n < k, 0).otherwise(n)
    return sequences(spark, d).select("plasmid_id", at_least(20).alias("scored"), at_least(100).alias("annotated"), (n >= 10).alias("usable_motif"))


@query("SELECT token, list(ln ORDER BY plasmid_id, ln) FILTER (WHERE pident >= 99) AS shown, count(*) FILTER (WHERE pident < 90.5) AS n_below FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def filter_confidence(spark, d):
    """What passes the confidence limit, and how many rows are below it."""
    shown = F.when(F.col("pident") >= 99, F.struct("plasmid_id", "ln"))
    t = annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("token").agg(F.array_sort(F.collect_list(shown)).alias("x"), F.count_if(F.col("pident") < 90.5).alias("n_below"))
    return t.select("token", F.when(F.size("x") > 0, F.transform("x", lambda r: r["ln"])).alias("shown"), "n_below")


@query("SELECT sseqid, token, length(sequence) AS n FROM reg LEFT JOIN seqs ON plasmid_id = sseqid")
def join_sequence_lookup(spark, d):
    """The length of each registry entry's sequence, null without one."""
    s = sequences(spark, d).select(F.col("plasmid_id").alias("sseqid"), F.length("sequence").cast("long").alias("n"))
    return registry(spark, d).select("sseqid", "token").join(s, "sseqid", "left")


@query(", m AS (SELECT s_suppkey AS sseqid, 'db' || s_nationkey AS db FROM supplier), a AS (SELECT l_partkey AS sseqid, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS db FROM lineitem GROUP BY 1) SELECT reg.sseqid, coalesce(m.db, a.db, 'unknown') AS db FROM reg LEFT JOIN m USING (sseqid) LEFT JOIN a USING (sseqid)")
def join_metadata_tiers(spark, d):
    """The source of each entry: from metadata, else the first seen in annotations (of equals the first row that has one), else unknown."""
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sseqid"), F.concat(F.lit("db"), F.col("s_nationkey").cast("string")).alias("meta"))
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")
    a = placed_table(spark, d, "lineitem").withColumn("at", at).where("l_linestatus is not null and at is not null")
    a = a.groupBy(F.col("l_partkey").alias("sseqid")).agg(F.min_by("l_linestatus", F.struct("at", *ROW_PLACE)).alias("seen"))
    return registry(spark, d).select("sseqid").join(m, "sseqid", "left").join(a, "sseqid", "left").select("sseqid", F.coalesce("meta", "seen", F.lit("unknown")).alias("db"))


@query(", b AS (SELECT token, coalesce(e.s_suppkey, l.s_suppkey) AS k FROM reg LEFT JOIN supplier e ON 'Supplier#' || lpad(sseqid::VARCHAR, 9, '0') = e.s_name LEFT JOIN supplier l ON lower('SUPPLIER#' || lpad((sseqid % 200)::VARCHAR, 9, '0')) = lower(l.s_name)) SELECT token, list_sort(list_distinct(list(k))) AS subjects FROM b WHERE k IS NOT NULL GROUP BY 1")
def join_bridge_sequences(spark, d):
    """The subjects of each token, matched exactly or without case; tokens without a match are absent."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    exact, folded = s.select(F.col("s_name").alias("x"), F.col("s_suppkey").alias("e")), s.select(F.lower("s_name").alias("y"), F.col("s_suppkey").alias("l"))
    name = lambda prefix, k: F.concat(F.lit(prefix), F.lpad(k.cast("string"), 9, "0"))
    r = registry(spark, d).select("token", name("Supplier#", F.col("sseqid")).alias("x"), F.lower(name("SUPPLIER#", F.col("sseqid") % 200)).alias("y"))
    both = r.join(exact, "x", "left").join(folded, "y", "left").select("token", F.coalesce("e", "l").alias("k")).where("k is not null")
    return both.groupBy("token").agg(F.array_sort(F.collect_set("k")).alias("subjects"))


