"""Contest queries: ranking, shares, roll-ups, winners, seats."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import ranking, rollups, seats
from hustings.plans.tables import PLACED_SQL, POS, options, placed, table

ORDERED = "l_quantity desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
RANKED_SQL = f"ranked as (select *, cast(row_number() over (partition by l_orderkey order by {ORDERED}) as integer) as rank from lineitem)"


def contest_winner(spark, sf_dir):
    best = ranking.best_per_group(rollups.share(options(spark, sf_dir), ["l_orderkey"], "l_quantity"), ["l_orderkey"], "l_quantity", POS, ["l_suppkey", "l_quantity", "share"])
    return best.select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("votes"), F.round("share", 6).alias("share"))


def contest_rank(spark, sf_dir):
    return ranking.rank_options(options(spark, sf_dir), ["l_orderkey"], "l_quantity", POS).select("l_orderkey", *POS, "rank", "won")


def contest_margin_topn(spark, sf_dir):
    shares = rollups.share(options(spark, sf_dir), ["l_orderkey"], "l_quantity").withColumn("share", F.round("share", 6))
    m = ranking.margins(shares, ["l_orderkey"], "share", POS).withColumn("margin", F.round("margin", 6))
    return ranking.closest(m, "margin", 30, 100, ["l_orderkey"])


def topk_winners(spark, sf_dir):
    k = F.when(F.col("l_orderkey") % 2 == 0, 2).otherwise(3)
    return ranking.top_k(options(spark, sf_dir), ["l_orderkey"], "l_quantity", POS, k).select("l_orderkey", *POS, "rank")


def close_race_count(spark, sf_dir):
    shares = rollups.share(options(spark, sf_dir), ["l_orderkey"], "l_quantity").withColumn("share", F.round("share", 6))
    m = ranking.margins(shares, ["l_orderkey"], "share", POS)
    return m.agg(F.count("*").alias("contests"), F.count_if(F.col("margin") < 5).alias("close"), F.count_if(F.col("margin").isNull()).alias("unopposed"))


def latest_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.latest(e, ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id", "value")


def vote_share(spark, sf_dir):
    out = rollups.share(options(spark, sf_dir), ["l_orderkey"], "l_quantity")
    return out.select("l_orderkey", *POS, F.round("share", 6).alias("share"))


def rollup_nation_region(spark, sf_dir):
    return rollups.recomputed_share(placed(spark, sf_dir), ["r_name"], ["l_returnflag", "l_linestatus"], "l_quantity", 6)


def share_rollup_sets(spark, sf_dir):
    out = rollups.roll_up(placed(spark, sf_dir), [["r_name", "n_name"], ["r_name"], []], ["l_returnflag"], "l_quantity")
    return out.select("r_name", "n_name", "l_returnflag", "votes", "level")


def turnout_ratio(spark, sf_dir):
    o = placed(spark, sf_dir).withColumn("scope", F.when(F.col("l_returnflag") == "A", "nation").when(F.col("l_returnflag") == "N", "district").otherwise("sido"))
    o = o.filter("NOT (scope = 'nation' AND r_name < 'B')").withColumn("voters", F.col("l_quantity") * 3).withColumn("electors", F.when(F.col("scope") == "sido", 0.0).otherwise(F.col("l_quantity") * 5 + F.col("l_linenumber")))
    return rollups.first_level_with_data(o, ["r_name"], "scope", ["nation", "sido", "district"], "voters", "electors")


def other_bucket(spark, sf_dir):
    shares = rollups.share(options(spark, sf_dir), ["l_orderkey"], "l_quantity").withColumn("share", F.round("share", 6))
    return rollups.other_bucket(shares, ["l_orderkey"], "share", 20.0).select("l_orderkey", "n_shown", F.round("others", 6).alias("others"))


def distinct_children(spark, sf_dir):
    c = placed(spark, sf_dir)
    out = rollups.distinct_children(c, ["l_returnflag", "r_name"], "n_name")
    return out.select("l_returnflag", "r_name", F.array_join("children", "|").alias("children"), F.col("n_children").cast("long").alias("n_children"))


def coverage_matrix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("source"))
    return rollups.coverage(o, "kind", "year", list(range(1995, 2002)), "source", ["F", "O", "P"])


def winner_count_by_party(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("flag", F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("l_returnflag") == "R")).withColumn("party", F.when(F.col("n_name") < "C", "").otherwise(F.col("n_name")))
    return seats.winner_counts(p, ["l_orderkey"], "flag", "l_quantity", POS, "party")


def summary_precedence(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("scope", F.when((F.col("l_linestatus") == "O") & (F.col("n_name") < "K"), "summary").otherwise("district"))
    p = p.withColumn("seats", F.col("l_linenumber").cast("long")).withColumn("won", F.col("l_quantity") >= 40)
    return seats.summary_or_winners(p, "scope", "summary", "seats", ["n_name"], "won")


def seat_split_satellite(spark, sf_dir):
    p = placed(spark, sf_dir)
    district = ranking.best_per_group(p, ["l_orderkey"], "l_quantity", POS, ["n_name"]).groupBy(F.col("n_name").alias("party")).agg(F.count("*").alias("seats"))
    lists = p.filter("l_returnflag = 'R'").groupBy(F.col("n_name").alias("party")).agg(F.sum(F.col("l_linenumber").cast("long")).alias("seats"))
    nation = table(spark, sf_dir, "nation")
    mains = nation.filter("n_nationkey % 5 = 1").alias("s").join(nation.alias("m"), F.col("s.n_nationkey") == F.col("m.n_nationkey") + 1).select(F.col("s.n_name").alias("party"), F.col("m.n_name").alias("main"))
    return seats.merged_totals([district, lists], "party", "seats", mains)


def plurality_by_region(spark, sf_dir):
    won = ranking.best_per_group(placed(spark, sf_dir), ["l_orderkey"], "l_quantity", POS, ["r_name", "n_name"]).withColumn("seats", F.lit(1).cast("long"))
    return seats.plurality(won, "r_name", "n_name", "seats")


def _party_votes(spark, sf_dir):
    v = placed(spark, sf_dir).groupBy("n_name", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("votes"))
    return v.withColumn("party", F.concat("l_returnflag", "l_linestatus")).select("n_name", "party", "votes").withColumn("seats", (F.length("n_name") % 5 + 3).cast("long"))


def apportion_hare(spark, sf_dir):
    return seats.largest_remainder(_party_votes(spark, sf_dir), ["n_name"], "votes", "seats", ["party"], threshold=0.05)


def apportion_capped(spark, sf_dir):
    v = _party_votes(spark, sf_dir).withColumn("votes", F.when(F.col("party") == "NO", F.col("votes") * 5).otherwise(F.col("votes")))
    return seats.largest_remainder(v, ["n_name"], "votes", "seats", ["party"], threshold=0.05, cap=(2, 3))


def largest_remainder(spark, sf_dir):
    return seats.largest_remainder(_party_votes(spark, sf_dir), ["n_name"], "votes", "seats", ["party"])


def seat_magnitude_split(spark, sf_dir):
    c = options(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n_candidates")).withColumn("area", F.floor(F.col("l_orderkey") / 16)).withColumn("seats", (F.col("area") % 7 + 9).cast("long"))
    return seats.magnitudes(c, ["area"], "seats", "n_candidates", ["l_orderkey"]).select("l_orderkey", "magnitude")


def uncontested_flags(spark, sf_dir):
    u = seats.uncontested(options(spark, sf_dir).withColumn("v", F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity"))), ["l_orderkey"], "v")
    return u.filter("is_uncontested").select("l_orderkey", "l_suppkey")


def single_approval(spark, sf_dir):
    o = seats.single_approval(options(spark, sf_dir).withColumn("voted", F.col("l_quantity") + F.col("l_linenumber")), ["l_orderkey"], "l_quantity", "voted")
    return o.filter("approval IS NOT NULL").select("l_orderkey", "l_suppkey", "approval")


def residual_seats(spark, sf_dir):
    v = _party_votes(spark, sf_dir)
    return v.select("n_name", "party", seats.residual_seats(F.col("votes") % 40, F.col("seats") * 3).cast("long").alias("residual"))


QUERIES = {
    f.__name__: f
    for f in (
        contest_winner, contest_rank, contest_margin_topn, topk_winners, close_race_count, latest_per_group, vote_share, rollup_nation_region, share_rollup_sets,
        turnout_ratio, other_bucket, distinct_children, coverage_matrix, winner_count_by_party, summary_precedence, seat_split_satellite, plurality_by_region,
        apportion_hare, apportion_capped, largest_remainder, seat_magnitude_split, uncontested_flags, single_approval, residual_seats,
    )
}

SHARES_SQL = "shares as (select *, round(l_quantity / sum(l_quantity) over (partition by l_orderkey) * 100, 6) as share from lineitem)"
MARGINS_SQL = f"""{SHARES_SQL}, two as (select l_orderkey, share, row_number() over (partition by l_orderkey order by share desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rank from shares),
margins as (select l_orderkey, max(share) filter (rank = 1) as first_share, max(share) filter (rank = 2) as second_share,
  max(share) filter (rank = 1) - max(share) filter (rank = 2) as margin from two where rank <= 2 group by l_orderkey)"""
VOTES_SQL = f"""{PLACED_SQL}, votes as (select n_name, l_returnflag || l_linestatus as party, cast(sum(l_quantity) as bigint) as votes, length(n_name) % 5 + 3 as seats
  from placed group by n_name, l_returnflag, l_linestatus)"""


def _apportioned(threshold: str, votes: str = "votes", cap: bool = False) -> str:
    base = f"""with {VOTES_SQL}, v0 as (select n_name, party, {votes} as votes, seats from votes),
a as (select *, votes >= sum(votes) over p * {threshold} as fine from v0 window p as (partition by n_name)),
b as (select *, sum(case when fine then votes else 0 end) over (partition by n_name) as s from a),
c as (select *, case when fine then (votes * seats) // cast(s as bigint) else 0 end as q, case when fine then (votes * seats) % cast(s as bigint) else -1 end as r from b),
d as (select *, row_number() over (partition by n_name order by r desc, party) as k, seats - sum(q) over (partition by n_name) as rest from c),
e as (select *, q + case when fine and k <= rest then 1 else 0 end as n from d)"""
    if not cap:
        return f"{base} select n_name, party, votes, cast(seats as bigint) as seats, cast(n as bigint) as n_seats from e"
    return f"""{base}, f as (select *, (seats * 2) // 3 as cap, case when (seats * 2) // 3 >= 1 then greatest(0, n - (seats * 2) // 3) else 0 end as over_cap from e),
g as (select *, sum(over_cap) over (partition by n_name) as excess, case when fine and over_cap = 0 and n < cap and cap >= 1 then 1 else 0 end as takes from f),
h as (select *, sum(takes) over (partition by n_name order by r desc, party rows unbounded preceding) as place from g)
select n_name, party, votes, cast(seats as bigint) as seats, cast(n - over_cap + case when takes = 1 and place <= excess then 1 else 0 end as bigint) as n_seats from h"""


ORACLE_SQL = {
    "contest_winner": f"""with {RANKED_SQL}, t as (select l_orderkey, sum(l_quantity) as total from lineitem group by 1)
select r.l_orderkey, l_suppkey, l_quantity as votes, round(l_quantity / total * 100, 6) as share from ranked r join t on r.l_orderkey = t.l_orderkey where rank = 1""",
    "contest_rank": f"with {RANKED_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank, rank = 1 as won from ranked",
    "contest_margin_topn": f"with {MARGINS_SQL} select l_orderkey, first_share, second_share, round(margin, 6) as margin from margins where round(margin, 6) < 30 order by round(margin, 6), l_orderkey limit 100",
    "topk_winners": f"with {RANKED_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank from ranked where rank <= case when l_orderkey % 2 = 0 then 2 else 3 end",
    "close_race_count": f"with {MARGINS_SQL} select count(*) as contests, count(*) filter (margin < 5) as close, count(*) filter (margin is null) as unopposed from margins",
    "latest_per_group": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id) = 1",
    "vote_share": f"with {SHARES_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, share from shares",
    "rollup_nation_region": f"""with {PLACED_SQL}, g as (select r_name, l_returnflag, l_linestatus, sum(l_quantity) as votes from placed group by all)
select *, round(votes / sum(votes) over (partition by r_name) * 100, 6) as share from g""",
    "share_rollup_sets": f"""with {PLACED_SQL} select r_name, n_name, l_returnflag, sum(l_quantity) as votes,
  case when grouping(n_name) = 0 then 0 when grouping(r_name) = 0 then 1 else 2 end as level
from placed group by grouping sets ((r_name, n_name, l_returnflag), (r_name, l_returnflag), (l_returnflag))""",
    "turnout_ratio": f"""with {PLACED_SQL}, s as (select *, case l_returnflag when 'A' then 'nation' when 'N' then 'district' else 'sido' end as scope from placed),
g as (select r_name, scope, sum(l_quantity * 3) as p, sum(case when scope = 'sido' then 0 else l_quantity * 5 + l_linenumber end) as w from s where not (scope = 'nation' and r_name < 'B') group by all)
select r_name, scope as used_level, round(p / w * 100, 2) as turnout from g where w > 0
qualify row_number() over (partition by r_name order by case scope when 'nation' then 0 when 'sido' then 1 else 2 end) = 1""",
    "other_bucket": f"""with {SHARES_SQL} select l_orderkey, count(*) filter (share >= 20) as n_shown,
  round(greatest(0, 100 - coalesce(sum(share) filter (share >= 20), 0)), 6) as others from shares group by 1""",
    "distinct_children": f"""with {PLACED_SQL} select l_returnflag, r_name, string_agg(distinct n_name, '|' order by n_name) as children, count(distinct n_name) as n_children from placed group by all""",
    "coverage_matrix": "select o_orderpriority as kind, " + ", ".join(f"""min(o_orderstatus) filter (year(o_orderdate) = {y}) as "{y}" """ for y in range(1995, 2002)) + " from orders group by 1",
    "winner_count_by_party": f"""with {PLACED_SQL}, f as (select *, case when l_orderkey % 3 = 0 then null else l_returnflag = 'R' end as flag from placed),
r as (select *, row_number() over (partition by l_orderkey order by {ORDERED}) as rank, bool_or(coalesce(flag, false)) over (partition by l_orderkey) as flagged from f)
select case when n_name < 'C' then 'independent' else n_name end as party, count(*) as n_won from r where case when flagged then coalesce(flag, false) else rank = 1 end group by 1""",
    "summary_precedence": f"""with {PLACED_SQL}, s as (select *, l_linestatus = 'O' and n_name < 'K' as summary from placed)
select n_name, cast(case when bool_or(summary) then sum(case when summary then l_linenumber else 0 end) else count(*) filter (not summary and l_quantity >= 40) end as bigint) as seats,
  bool_or(summary) as from_summary from s group by 1""",
    "seat_split_satellite": f"""with {PLACED_SQL}, w as (select n_name from placed qualify row_number() over (partition by l_orderkey order by {ORDERED}) = 1),
every as (select n_name, count(*) as seats from w group by 1 union all select n_name, sum(l_linenumber) from placed where l_returnflag = 'R' group by 1),
mains as (select s.n_name as party, m.n_name as main from nation s join nation m on s.n_nationkey = m.n_nationkey + 1 where s.n_nationkey % 5 = 1)
select coalesce(main, n_name) as party, cast(sum(seats) as bigint) as seats from every left join mains on party = n_name group by 1""",
    "plurality_by_region": f"""with {PLACED_SQL}, w as (select r_name, n_name from placed qualify row_number() over (partition by l_orderkey order by {ORDERED}) = 1),
g as (select r_name, n_name, count(*) as seats from w group by all), t as (select *, sum(seats) over (partition by r_name) as total from g)
select r_name, n_name, seats, round(seats / total * 100, 2) as seat_share from t qualify row_number() over (partition by r_name order by seats desc, n_name) = 1""",
    "apportion_hare": _apportioned("0.05"),
    "apportion_capped": _apportioned("0.05", "case when party = 'NO' then votes * 5 else votes end", cap=True),
    "largest_remainder": _apportioned("0"),
    "seat_magnitude_split": """with c as (select l_orderkey, count(*) as n from lineitem group by 1), a as (select *, l_orderkey // 16 as area, (l_orderkey // 16) % 7 + 9 as seats from c)
select l_orderkey, cast(seats // count(*) over p + case when row_number() over (partition by area order by n desc, l_orderkey) <= seats % count(*) over p then 1 else 0 end as bigint) as magnitude
from a window p as (partition by area)""",
    "uncontested_flags": "select l_orderkey, l_suppkey from lineitem qualify count(*) over (partition by l_orderkey) = 1 and case when l_returnflag = 'A' then 0 else l_quantity end = 0",
    "single_approval": "select l_orderkey, l_suppkey, round(l_quantity / (l_quantity + l_linenumber) * 100, 2) as approval from lineitem qualify count(*) over (partition by l_orderkey) = 1",
    "residual_seats": f"with {VOTES_SQL} select n_name, party, greatest(0, votes % 40 - seats * 3) as residual from votes",
}
