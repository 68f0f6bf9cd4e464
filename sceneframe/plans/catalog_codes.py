"""Queries over latent codes, attention, atoms, actions, errors and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneframe.functions import codes as C
from sceneframe.operators import actions as A
from sceneframe.operators import atoms as L
from sceneframe.operators import bits as N
from sceneframe.operators import errors as E
from sceneframe.operators import noise as X
from sceneframe.operators import rowsets as Z
from sceneframe.operators import slots as S
from sceneframe.operators import usage as U
from sceneframe.operators.ordering import stable_hash
from sceneframe.plans import views as V
from sceneframe.plans.catalog_scenes import h60
from sceneframe.plans.registry import query

UNITS, ARGS, OBJECTS, PREDICATES = 4, 2, 8, 16
THRESHOLD = 0.1


def names_of(state):
    """Object names of a state: 8 objects, every fifth state lists only six of them."""
    names = F.transform(F.sequence(F.lit(0), F.lit(OBJECTS - 1)), lambda i: F.concat_ws("_", F.lit("thing"), (state + i).cast("string")))
    return F.when(state % 5 == 0, F.slice(names, 1, 6)).otherwise(names)


def encoded(spark, sf):
    """States with bits, attention and names: one scan of the embeddings."""
    e = V.attention(spark, sf)
    c = V.codes(spark, sf)
    return c.join(e, "state_id").withColumn("object_names", names_of(F.col("state_id")))


def bound(spark, sf):
    emb = V.table(spark, sf, "embeddings")
    e = F.col("embedding")
    rows = emb.select(
        F.col("vec_id").alias("state_id"), F.col("label").alias("action"),
        F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"),
        F.array(*[F.array(*[F.slice(e, u * 16 + a * 8 + 1, 8).cast("array<double>") for a in range(ARGS)])
                  for u in range(UNITS)]).alias("attention"),
    ).withColumn("object_names", names_of(F.col("state_id")))
    return L.bind_arguments(rows)


BOUND = V.ATTENTION + """,
args as (select state_id, unit, arg, max(w) as conf,
                (list(obj order by w desc, obj))[1] as obj from attention group by state_id, unit, arg),
units as (select state_id, unit, min(conf) as conf, list(obj order by arg) as objs from args group by state_id, unit)"""

NAME_OF = "case when state_id % 5 = 0 and o >= 6 then 'obj_' || o else 'thing_' || (state_id + o) end"

ATOMS = V.CODES + "," + BOUND + f""",
atoms as (select u.state_id, u.unit, c.idx % 16 as p, u.objs, u.conf, c.bit = 1 as value,
            case when c.bit = 1 then '' else '~' end || 'pred_' || (c.idx % 16) || '(' ||
            (select string_agg({NAME_OF.replace('state_id', 'u.state_id')}, ', ' order by a) from (select unnest(u.objs) as o, generate_subscripts(u.objs, 1) as a)) || ')' as atom_str
          from units u join codes c on c.state_id = u.state_id and c.idx // 16 = u.unit)"""


@query("argmax_first", f"""with {BOUND} select state_id, unit, arg, cast(obj as int) as obj, round(conf, 6) as conf from args""")
def _argmax(spark, sf):
    b = L.bindings_long(bound(spark, sf), "state_id")
    return b.select("state_id", F.col("unit").cast("long").alias("unit"), F.col("arg").cast("long").alias("arg"), "obj", F.round("conf", 6).alias("conf"))


@query("unit_confidence", f"with {BOUND} select state_id, unit, round(conf, 6) as conf from units")
def _unit_confidence(spark, sf):
    return bound(spark, sf).select("state_id", F.posexplode("unit_confidence").alias("unit", "c")).select(
        "state_id", F.col("unit").cast("long").alias("unit"), F.round("c", 6).alias("conf"))


@query("confidence_filter", f"with {BOUND} select state_id, unit from units where conf >= {THRESHOLD}")
def _confidence_filter(spark, sf):
    u = bound(spark, sf).select("state_id", F.posexplode("unit_confidence").alias("unit", "conf"))
    return L.confidence_filter(u, "conf", THRESHOLD).select("state_id", F.col("unit").cast("long").alias("unit"))


@query("bind_names", f"""with {BOUND}, n as (select state_id, unit, arg, obj as o from args)
select state_id, unit, arg, {NAME_OF} as argument_name from n""")
def _bind_names(spark, sf):
    b = bound(spark, sf)
    slots = b.select("state_id", F.posexplode("object_names").alias("slot", "name"))
    named = S.bind_names(L.bindings_long(b, "state_id"), slots, "state_id", "obj")
    return named.select("state_id", F.col("unit").cast("long").alias("unit"), F.col("arg").cast("long").alias("arg"), "argument_name")


@query("per_state_names", """select vec_id as state_id, cast(i as int) as slot,
  'thing_' || (vec_id + i) as name from embeddings, range(8) t(i) where not (vec_id % 5 = 0 and i >= 6)""")
def _per_state_names(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("state_id"))
    names = e.withColumn("object_names", names_of(F.col("state_id")))
    return S.state_names(e, names, "state_id").select("state_id", F.posexplode("object_names").alias("slot", "name"))


@query("shared_names", """select vec_id as state_id, cast(i as int) as slot, 'block_' || i as name from embeddings, range(5) t(i)""")
def _shared_names(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("state_id"))
    return S.state_names(e, [f"block_{i}" for i in range(5)], "state_id").select("state_id", F.posexplode("object_names").alias("slot", "name"))


@query("atoms", f"""with {ATOMS}
select state_id, unit, p as predicate_idx, array_to_string(objs, ',') as arguments, value, round(conf, 6) as confidence, atom_str
from atoms where conf >= {THRESHOLD}""")
def _atoms(spark, sf):
    rows = L.atoms(bound(spark, sf), "state_id", PREDICATES, "object_names", threshold=THRESHOLD)
    return rows.select(
        "state_id", F.col("unit").cast("long").alias("unit"), F.col("predicate_idx").cast("long").alias("predicate_idx"),
        F.array_join(F.col("arguments").cast("array<string>"), ",").alias("arguments"), "value", F.round("confidence", 6).alias("confidence"), "atom_str")


@query("active_atoms", f"""with {ATOMS}
select state_id, count(*) as atoms, min(atom_str) as first_atom from atoms where value group by state_id""")
def _active_atoms(spark, sf):
    rows = L.atoms(bound(spark, sf), "state_id", PREDICATES, "object_names", threshold=-1.0)
    return L.active_atoms(rows).groupBy("state_id").agg(F.count("*").alias("atoms"), F.min("atom_str").alias("first_atom"))


@query("state_results", f"""with {ATOMS},
a as (select state_id, count(*) as atoms, count(*) filter (where value) as active,
        string_agg(case when value then atom_str end, ';' order by unit, p) as strs from atoms where conf >= {THRESHOLD} group by state_id)
select e.vec_id as state_id, coalesce(atoms, 0) as atoms, coalesce(active, 0) as active, coalesce(strs, '') as active_atom_strs
from embeddings e left join a on a.state_id = e.vec_id""")
def _state_results(spark, sf):
    r = L.state_results(bound(spark, sf), "state_id", PREDICATES, "object_names", threshold=THRESHOLD)
    return r.select("state_id", F.size("atoms").cast("long").alias("atoms"), F.size("active_atoms").cast("long").alias("active"),
                    F.array_join("active_atom_strs", ";").alias("active_atom_strs"))


@query("bits_with_bindings", f"""with {V.CODES}, {BOUND}
select u.state_id, u.unit, c.idx % 16 as pred, c.bit, array_to_string(u.objs, ',') as arguments, round(u.conf, 6) as confidence
from units u join codes c on c.state_id = u.state_id and c.idx // 16 = u.unit""")
def _bits_with_bindings(spark, sf):
    b = bound(spark, sf)
    bits = b.select("state_id", F.posexplode("bits").alias("idx", "bit")).select(
        "state_id", C.unit_of(F.col("idx"), PREDICATES).alias("unit"), C.predicate_of(F.col("idx"), PREDICATES).alias("pred"), "bit")
    joined = L.bits_with_bindings(bits, L.bindings_long(b, "state_id"), "state_id")
    return joined.select("state_id", F.col("unit").cast("long").alias("unit"), F.col("pred").cast("long").alias("pred"), "bit",
                         F.array_join(F.col("arguments").cast("array<string>"), ",").alias("arguments"), F.round("confidence", 6).alias("confidence"))


@query("reshape_bits", f"with {V.CODES} select state_id, idx // 8 as unit, idx % 8 as pred, bit from codes")
def _reshape(spark, sf):
    bits = V.bits_long(V.codes(spark, sf), "bits", "bit", ["state_id"])
    return bits.select("state_id", C.unit_of(F.col("idx"), 8).cast("long").alias("unit"), C.predicate_of(F.col("idx"), 8).cast("long").alias("pred"), "bit")


@query("round_bits", """select vec_id as state_id, i as idx, cast(round_even(embedding[i+1]::double * 4, 0) as int) as v,
  cast(round_even((vec_id + i) / 2.0::double, 0) as int) as half from embeddings, range(64) t(i)""")
def _round_bits(spark, sf):
    e = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("state_id"),
        C.round_bits(F.transform("embedding", lambda x: x.cast("double") * 4)).alias("a"),
        C.round_bits(F.transform("embedding", lambda x, i: (F.col("vec_id") + i) / F.lit(2.0))).alias("b"))
    return e.select("state_id", F.posexplode(F.arrays_zip("a", "b")).alias("idx", "z")).select(
        "state_id", F.col("idx").cast("long").alias("idx"), F.col("z.a").alias("v"), F.col("z.b").alias("half"))


@query("hard_onehot", f"""with {BOUND}
select a.state_id, a.unit, a.arg, a.obj, cast(a.obj = g.obj as int) as hot from attention a join args g using (state_id, unit, arg)""")
def _hard_onehot(spark, sf):
    a = V.attention(spark, sf).select("state_id", F.posexplode("attention").alias("unit", "u")).select(
        "state_id", "unit", F.posexplode("u").alias("arg", "w"))
    return a.select("state_id", "unit", "arg", F.posexplode(C.hard_onehot(F.col("w"))).alias("obj", "hot")).select(
        "state_id", *[F.col(c).cast("long").alias(c) for c in ["unit", "arg", "obj"]], "hot")


@query("diff_map", """select a.vec_id as state_id, i as idx, round((b.embedding[i+1]::double - a.embedding[i+1]::double + 1) / 2, 6) as signed,
  round(abs(b.embedding[i+1]::double - a.embedding[i+1]::double), 6) as absolute
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1, range(64) t(i)""")
def _diff_map(spark, sf):
    p = real_pairs(spark, sf, squash=False)
    d = p.select("state_id", F.posexplode(F.arrays_zip(C.diff_map(F.col("x"), F.col("y")).alias("s"), C.abs_diff(F.col("x"), F.col("y")).alias("a"))).alias("idx", "z"))
    return d.select("state_id", F.col("idx").cast("long").alias("idx"), F.round("z.s", 6).alias("signed"), F.round("z.a", 6).alias("absolute"))


@query("weighted_arguments", f"""with {V.ATTENTION},
feat as (select vec_id as state_id, i // 8 as obj, i % 8 as f, cast(embedding[i+1] as double) as v from embeddings, range(64) t(i))
select a.state_id, a.unit, a.arg, g.f, round(sum(a.w * g.v), 6) + 0.0 as value
from attention a join feat g on a.state_id = g.state_id and a.obj = g.obj group by all""")
def _weighted_arguments(spark, sf):
    e = F.col("embedding").cast("array<double>")
    att = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("state_id"),
        F.array(*[F.slice(e, o * 8 + 1, 8) for o in range(8)]).alias("features"),
        F.posexplode(F.array(*[F.slice(e, ua * 8 + 1, 8) for ua in range(8)])).alias("ua", "w"))
    args = att.select("state_id", F.floor(F.col("ua") / 2).alias("unit"), (F.col("ua") % 2).cast("long").alias("arg"),
                      F.posexplode(C.weighted_arguments(F.col("w"), F.col("features"), 8)).alias("f", "value"))
    return args.select("state_id", "unit", "arg", F.col("f").cast("long").alias("f"), (F.round("value", 6) + 0.0).alias("value"))


# ---- usage

USAGE = V.CODES + """,
rates as (select idx // 8 as unit, idx % 8 as predicate, sum(bit) / count(*)::double as rate from codes group by idx),
usage as (select unit, predicate, round_even(rate, 4) as activation_rate,
   case when rate > 0.99 then 'always_on' when rate < 0.01 then 'always_off' else 'variable' end as usage from rates)"""


@query("predicate_usage", f"""with {USAGE}
select cast(unit as int) as unit, cast(predicate as int) as predicate, activation_rate, usage from usage""")
def _usage(spark, sf):
    return U.predicate_usage(V.codes(spark, sf), 8)


@query("usage_totals", f"""with {USAGE} select count(*) filter (where usage = 'always_on') as num_always_on,
 count(*) filter (where usage = 'always_off') as num_always_off, count(*) filter (where usage = 'variable') as num_variable from usage""")
def _usage_totals(spark, sf):
    return U.usage_totals(_usage(spark, sf))


@query("variable_predicates_by_rate", f"""with {USAGE}
select cast(unit as int) as unit, cast(predicate as int) as predicate, activation_rate from usage where usage = 'variable'
order by activation_rate desc, unit, predicate""")
def _variable(spark, sf):
    return U.variable_predicates_by_rate(_usage(spark, sf))


@query("head_states", "select vec_id, label from embeddings order by vec_id limit 50")
def _head(spark, sf):
    return U.head_states(V.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 50)


@query("mean_attention", f"""with {V.ATTENTION}
select cast(unit as int) as unit, cast(arg as int) as arg, cast(obj as int) as obj, round(avg(w), 6) + 0.0 as weight from attention group by unit, arg, obj""")
def _mean_attention(spark, sf):
    m = U.mean_attention(V.attention(spark, sf))
    return m.withColumn("weight", F.round("weight", 6) + 0.0)


@query("sample_examples", f"""with {V.CODES}, b as (select state_id, idx % 8 as pred, idx // 8 as unit, bit from codes),
r as (select *, row_number() over (partition by pred, bit order by {h60("state_id || '|' || unit || '|' || pred", 9)}, state_id, unit) - 1 as example from b)
select state_id, cast(unit as int) as unit, cast(pred as int) as pred, bit, cast(example as int) as example from r
where example < 5 and pred in (select pred from b where bit = 1)""")
def _sample_examples(spark, sf):
    bits = V.bits_long(V.codes(spark, sf), "bits", "bit", ["state_id"]).select(
        "state_id", C.unit_of(F.col("idx"), 8).alias("unit"), C.predicate_of(F.col("idx"), 8).alias("pred"), "bit")
    return U.sample_examples(bits, "pred", "bit", ["state_id", "unit"], 5, stable_hash("state_id", "unit", "pred", seed=9))


# ---- bit statistics

@query("bit_stats", f"""with {V.CODES}, b as (select idx, min(bit) as lo, max(bit) as hi, sum(bit) as s, count(*) as n from codes group by idx)
select round(sum(s) / sum(n), 6) as activation, sum(hi)::double as ever_1, sum(1-lo)::double as ever_0, sum((1-lo)*hi)::double as effective from b""")
def _bit_stats(spark, sf):
    return N.bit_stats(V.codes(spark, sf)).withColumn("activation", F.round("activation", 6))


@query("code_variance", """with e as (select vec_id, i, r, cast(floor(abs(embedding[i+1]::double) * 1000 + r * r * 7) as bigint) % 3 = 0 as b
   from embeddings, range(64) t(i), range(10) s(r)),
v as (select vec_id, i, var_pop(b::int) as v from e group by vec_id, i)
select round(max(v), 4) as max, round(min(v), 4) as min, round(avg(v), 4) as mean, round(median(v), 4) as median from v""")
def _code_variance(spark, sf):
    r = F.col("r")
    enc = V.table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r")).select(
        F.col("vec_id").alias("state_id"),
        F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000 + r * r * 7) % 3 == 0).cast("int")).alias("bits"))
    v = N.code_variance(enc, "state_id")
    return v.select(*[F.round(c, 4).alias(c) for c in v.columns])


@query("mean_hamming", f"with {V.TRANSITION_CODES} select round(avg(abs(suc - pre)), 6) as hamming from tcodes")
def _hamming(spark, sf):
    return N.mean_hamming(V.transition_codes(spark, sf)).select(F.round("hamming", 6).alias("hamming"))


def real_pairs(spark, sf, squash=True):
    """Successive states as two real-valued rows; squashed into (0, 1) by the logistic function."""
    f = (lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))) if squash else (lambda x: x.cast("double"))
    e = V.table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("state_id"), "label", F.transform("embedding", f).alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("state_id"), F.transform("embedding", f).alias("y"))
    return a.join(b, "state_id")


REAL = """pairs as (select a.vec_id as state_id, a.label, i as idx, 1 / (1 + exp(-a.embedding[i+1]::double)) as x,
                  1 / (1 + exp(-b.embedding[i+1]::double)) as y
           from embeddings a join embeddings b on b.vec_id = a.vec_id + 1, range(64) t(i))"""


@query("prediction_match", f"""with {REAL},
bit as (select idx, avg(1 - abs(y - x)) as m from pairs group by idx),
r as (select state_id, exp(sum(ln(1 - abs(y - x)))) as m from pairs group by state_id)
select round((select avg(abs(y - x)) from pairs), 6) as z_mae, round((select sum(ln(m)) from bit), 6) as log_prob_bitwise,
       round(ln((select avg(m) from r)), 6) as log_allmatch""")
def _prediction_match(spark, sf):
    m = N.prediction_match(real_pairs(spark, sf), "y", "x")
    return m.select(F.round("z_mae", 6).alias("z_mae"), F.round(F.log("z_prob_bitwise"), 6).alias("log_prob_bitwise"),
                    F.round(F.log("z_allmatch"), 6).alias("log_allmatch"))


@query("code_similarity", f"""with {REAL},
r as (select state_id, -sum(x*y) / (sqrt(sum(x*x)) * sqrt(sum(y*y))) as c, avg(y - x * ln(y + 1e-7)) as p from pairs group by state_id)
select round(avg(c), 6) as cosine, round(avg(p), 6) as poisson from r""")
def _code_similarity(spark, sf):
    s = N.code_similarity(real_pairs(spark, sf), "x", "y")
    return s.select(F.round("cosine", 6).alias("cosine"), F.round("poisson", 6).alias("poisson"))


@query("repeat_rows", "select vec_id, label, cast(r as int) as repeat from embeddings, range(10) t(r)")
def _repeat(spark, sf):
    return N.repeat_rows(V.table(spark, sf, "embeddings").select("vec_id", "label"), 10)


@query("canonical_object_order", f"""with {V.CODES}, o as (select state_id, idx // 8 as obj, string_agg(bit::varchar, '' order by idx) as s from codes group by all)
select state_id, string_agg(s, ',' order by s) as objects from o group by state_id""")
def _canonical(spark, sf):
    u = V.units(spark, sf)
    return u.select("state_id", F.array_join(N.canonical_object_order(F.col("units")), ",").alias("objects"))


@query("embedding_activity", "select round(avg(v::double), 6) + 0.0 as activity from (select unnest(embedding) as v from embeddings)")
def _activity(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.array(F.col("embedding").cast("array<double>")).alias("objs"))
    return N.embedding_activity(e, "objs").select((F.round("activity", 6) + 0.0).alias("activity"))


# ---- actions

@query("action_histogram", f"with {V.TRANSITION_CODES} select action, count(*) // 64 as n from tcodes group by action")
def _histogram(spark, sf):
    return A.action_histogram(V.transition_codes(spark, sf))


@query("action_count", f"with {V.TRANSITION_CODES} select count(distinct action) as true_num_actions from tcodes")
def _action_count(spark, sf):
    return A.action_count(V.transition_codes(spark, sf))


@query("action_id", "select vec_id as state_id, label as action from embeddings")
def _action_id(spark, sf):
    e = V.table(spark, sf, "embeddings")
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return e.select(F.col("vec_id").alias("state_id"), C.action_id(hot).alias("action"))


EFFECTS = V.TRANSITION_CODES + """,
effects as (select action, idx, max(greatest(suc - pre, 0)) as add, max(greatest(pre - suc, 0)) as del from tcodes group by action, idx)"""


@query("action_effects", f"with {EFFECTS} select action, cast(idx as int) as idx, add, del from effects")
def _effects(spark, sf):
    return A.action_effects(V.transition_codes(spark, sf))


@query("apply_effects", f"""with {EFFECTS}
select t.pre_id, t.action, string_agg(least(1 - e.del, greatest(e.add, t.pre))::varchar, '' order by t.idx) as predicted
from tcodes t join effects e on t.action = e.action and t.idx = e.idx group by t.pre_id, t.action""")
def _apply(spark, sf):
    return predicted(spark, sf).select("pre_id", "action", F.array_join(F.col("predicted").cast("array<string>"), "").alias("predicted"))


def predicted(spark, sf, rule=C.apply_effects):
    t = V.transition_codes(spark, sf)
    return A.predict_successors(t, A.action_effects(t), rule=rule)


@query("apply_effects_additive", f"""with {EFFECTS}
select t.pre_id, t.action, string_agg(cast(round_even(1 / (1 + exp(-(t.pre - 0.5 + e.add - e.del)::double)), 0) as int)::varchar, '' order by t.idx) as predicted
from tcodes t join effects e on t.action = e.action and t.idx = e.idx group by t.pre_id, t.action""")
def _apply_additive(spark, sf):
    return predicted(spark, sf, C.apply_effects_additive).select(
        "pre_id", "action", F.array_join(F.col("predicted").cast("array<string>"), "").alias("predicted"))


@query("action_entropy", f"""with {V.TRANSITION_CODES}, p as (select action, idx, avg(pre) as p from tcodes group by action, idx),
h as (select action, sum(-(p * ln(p + 1e-20) + (1-p) * ln(1 - p + 1e-20))) as h from p group by action)
select round(avg(h), 6) as h_z_given_a from h""")
def _entropy(spark, sf):
    return A.action_entropy(V.transition_codes(spark, sf)).select(F.round("h_z_given_a", 6).alias("h_z_given_a"))


@query("stack_observed_predicted", f"""with {EFFECTS},
s as (select t.pre_id, t.action, string_agg(t.pre::varchar, '' order by t.idx) as pre, string_agg(t.suc::varchar, '' order by t.idx) as suc,
        string_agg(least(1 - e.del, greatest(e.add, t.pre))::varchar, '' order by t.idx) as pred
      from tcodes t join effects e on t.action = e.action and t.idx = e.idx group by t.pre_id, t.action)
select pre_id, action, 'observed' as origin, pre || suc as code from s
union all select pre_id, action, 'predicted', pre || pred from s""")
def _stack(spark, sf):
    s = A.stack_observed_predicted(predicted(spark, sf), ["pre_id", "action"])
    return s.select("pre_id", "action", "origin", F.array_join(F.concat("pre", "suc").cast("array<string>"), "").alias("code"))


# ---- errors

BCE = "-(x * ln(greatest(least(y, 1.0), 1e-7)) + (1-x) * ln(greatest(least(1-y, 1.0), 1e-7)))"


@query("error_metrics", f"with {REAL} select round(avg({BCE}), 6) as bce, round(avg(abs(x-y)), 6) as mae, round(avg((x-y)*(x-y)), 6) as mse from pairs")
def _error_metrics(spark, sf):
    m = E.error_metrics(real_pairs(spark, sf), "x", "y")
    return m.select(*[F.round(c, 6).alias(c) for c in ["bce", "mae", "mse"]])


@query("error_metrics_by_feature", f"""with {REAL}
select cast(idx as int) as idx, round(avg({BCE}), 6) as bce, round(avg(abs(x-y)), 6) as mae, round(avg((x-y)*(x-y)), 6) as mse from pairs group by idx""")
def _error_metrics_axis(spark, sf):
    m = E.error_metrics(real_pairs(spark, sf), "x", "y", axis="feature")
    return m.select("idx", *[F.round(c, 6).alias(c) for c in ["bce", "mae", "mse"]])


@query("sum_errors", f"with {REAL} select state_id, round(sum({BCE}), 6) as bce2, round(sum((x-y)*(x-y)), 6) as se from pairs group by state_id")
def _sum_errors(spark, sf):
    p = real_pairs(spark, sf).withColumn("e", E.sum_errors(F.col("x"), F.col("y")))
    return p.select("state_id", F.round("e.bce2", 6).alias("bce2"), F.round("e.se", 6).alias("se"))


@query("mean_errors", f"""with {REAL}
select state_id, round(avg({BCE}), 6) as bce, round(avg((x-y)*(x-y)), 6) as mse, round(avg(abs(x-y)), 6) as mae,
  round(-sum(x * ln(y / s)), 6) as cce
from (select *, sum(y) over (partition by state_id) as s from pairs) group by state_id""")
def _mean_errors(spark, sf):
    x, y = F.col("x"), F.col("y")
    p = real_pairs(spark, sf).withColumn("e", E.mean_errors(x, y))
    return p.select("state_id", *[F.round(f"e.{c}", 6).alias(c) for c in ["bce", "mse", "mae"]],
                    F.round(E.ranked_cross_entropy(x, y, categorical=True), 6).alias("cce"))


def object_pairs(spark, sf):
    p = real_pairs(spark, sf)
    return p.select("state_id", *[F.array(*[F.slice(c, o * 8 + 1, 8) for o in range(8)]).alias(c) for c in ["x", "y"]])


def set_oracle(element: str) -> str:
    return f"""with {REAL},
o as (select state_id, idx // 8 as obj, idx % 8 as f, x, y from pairs),
d as (select a.state_id, a.obj as xo, b.obj as yo, sum({element}) as d from o a join o b on a.state_id = b.state_id and a.f = b.f group by all),
nx as (select state_id, xo, min(d) as m from d group by all), ny as (select state_id, yo, min(d) as m from d group by all),
sx as (select state_id, max(m) as h, sum(m) as s from nx group by all), sy as (select state_id, max(m) as h, sum(m) as s from ny group by all)
select round(avg(greatest(sx.h, sy.h)), 6) as hausdorff, round(avg(sx.h), 6) as directed_hausdorff_1, round(avg(sy.h), 6) as directed_hausdorff_2,
  round(avg(greatest(sx.s, sy.s)), 6) as sum_min, round(avg(sx.s), 6) as directed_sum_min_1, round(avg(sy.s), 6) as directed_sum_min_2
from sx join sy using (state_id)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("set_distance", set_oracle("(a.x - b.y) * (a.x - b.y)"))
def _set_distance(spark, sf):
    return _rounded(E.set_distances(object_pairs(spark, sf), "x", "y"))


@query("set_distance_bce", set_oracle("-(a.x * ln(b.y) + (1 - a.x) * ln(1 - b.y))"))
def _set_distance_bce(spark, sf):
    return _rounded(E.set_distances(object_pairs(spark, sf), "x", "y", E.bounded_cross_entropy))


PERM = X.shared_permutation(8, 1)
PERM_SQL = "[" + ",".join(map(str, PERM)) + "]"


@query("order_sensitivity", f"""with {REAL},
o as (select state_id, idx // 8 as obj, idx % 8 as f, x, y from pairs),
z as (select a.state_id, avg((a.x - a.y) * (a.x - a.y)) as ordered, avg((b.x - a.y) * (b.x - a.y)) as shuffled
      from o a join o b on a.state_id = b.state_id and a.f = b.f and b.obj = ({PERM_SQL})[a.obj + 1] group by a.state_id)
select 'ordered' as variant, round(avg(ordered), 6) as value from z union all select 'shuffled', round(avg(shuffled), 6) from z""")
def _order_sensitivity(spark, sf):
    return E.order_sensitivity(object_pairs(spark, sf), "x", "y", PERM).withColumn("value", F.round("value", 6))


@query("metric_report", f"""with {REAL}, s as (select *, case when state_id % 10 < 9 then 'train' else 'test' end as split from pairs),
m as (select split, avg({BCE}) as bce, avg(abs(x-y)) as mae, avg((x-y)*(x-y)) as mse from s group by split),
b as (select split, idx, min(x) as lo, max(x) as hi, sum(x) as t, count(*) as n from
        (select split, idx, round_even(x, 0) as x from s) group by split, idx),
g as (select split, sum(t)/sum(n) as activation, sum(hi) as ever_1, sum(1-lo) as ever_0, sum((1-lo)*hi) as effective from b group by split),
r as (select 'bce' as metric, split, bce as value from m union all select 'mae', split, mae from m union all select 'mse', split, mse from m
  union all select 'activation', split, activation from g union all select 'ever_1', split, ever_1 from g
  union all select 'ever_0', split, ever_0 from g union all select 'effective', split, effective from g)
select metric, 'vanilla' as variant, split, round(value, 6) as value from r""")
def _metric_report(spark, sf):
    p = real_pairs(spark, sf).withColumn("split", F.when(F.col("state_id") % 10 < 9, "train").otherwise("test"))
    rows = p.withColumn("variant", F.lit("vanilla")).withColumn("bits", C.round_bits(F.col("x")))
    return E.model_report(rows, "x", "y", "bits").select("metric", "variant", "split", F.round("value", 6).alias("value"))


@query("metric_report_noise")
def _metric_report_noise(spark, sf):
    """The report under every noise variant; keyed noise has no SQL twin."""
    p = real_pairs(spark, sf).withColumn("split", F.when(F.col("state_id") % 10 < 9, "train").otherwise("test"))
    x, key = F.col("x"), F.col("state_id")
    kinds = {"vanilla": x, "gaussian": X.noisy_array(x, key, X.noise_gaussian), "salt": X.noisy_array(x, key, X.noise_salt),
             "pepper": X.noisy_array(x, key, X.noise_pepper), "flip": X.noisy_array(x, key, X.noise_flip)}
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("noisy")) for k, v in kinds.items()])
    rows = p.select("split", "x", F.inline(variants)).withColumn("bits", C.round_bits(F.col("noisy")))
    return E.model_report(rows, "x", "noisy", "bits")


# ---- noise and shuffles

def _u(seed: int) -> str:
    """SQL of the uniform number of a pixel."""
    return f"({h60("img || '|' || y || '|' || x", seed)} >> 7)::double / 9007199254740992.0::double"


NOISE_SQL = {
    "noise_gaussian": f"least(greatest(s + 0.3::double * sqrt(-2.0::double * ln(1.0::double - {_u(8)})) * cos(2.0::double * pi() * {_u(9)}), 0.0), 1.0)",
    "noise_salt": f"case when {_u(4)} < 0.06::double then 1.0::double else s end",
    "noise_pepper": f"case when {_u(4)} < 0.06::double then 0.0::double else s end",
    "noise_flip": f"case when {_u(4)} < 0.06::double then 1.0::double - s else s end",
}


def _noise(name, fn):
    @query(name, f"with {V.PIXELS}, p as (select img, y, x, 1.0::double / (1.0::double + exp(-v::double)) as s from pixels) "
                 f"select img, y, x, round({NOISE_SQL[name]}, 9) + 0.0 as v from p")
    def run(spark, sf):
        p = V.pixels(spark, sf)
        value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("v")))
        noisy = fn(value, F.col("img"), F.col("y"), F.col("x"), seed=4)
        return p.select("img", "y", "x", (F.round(noisy, 9) + 0.0).alias("v"))


for _name, _fn in {"noise_gaussian": X.noise_gaussian, "noise_salt": X.noise_salt,
                   "noise_pepper": X.noise_pepper, "noise_flip": X.noise_flip}.items():
    _noise(_name, _fn)


@query("shuffle_objects", f"""with {V.CODES}, o as (select state_id, idx // 8 as obj, string_agg(bit::varchar, '' order by idx) as s from codes group by all)
select state_id, cast(list_position({PERM_SQL}, obj) - 1 as int) as slot, s as code from o""")
def _shuffle_objects(spark, sf):
    u = V.units(spark, sf).select("state_id", F.posexplode("units").alias("slot", "b"))
    return X.shuffle_objects(u, PERM).select("state_id", "slot", F.array_join(F.col("b").cast("array<string>"), "").alias("code"))


@query("shuffle_objects_per_state", f"""with {V.CODES}, o as (select state_id, idx // 8 as obj, string_agg(bit::varchar, '' order by idx) as s from codes group by all)
select state_id, cast(row_number() over (partition by state_id order by {h60("state_id || '|' || obj", 2)}, obj) - 1 as int) as slot, s as code from o""")
def _shuffle_per_state(spark, sf):
    u = V.units(spark, sf).select("state_id", F.posexplode("units").alias("slot", "b"))
    return X.shuffle_objects_per_state(u, "state_id", seed=2).select(
        "state_id", "slot", F.array_join(F.col("b").cast("array<string>"), "").alias("code"))


# ---- row sets

A_ROWS = "a as (select l_partkey as p, l_suppkey as s from lineitem where l_returnflag <> 'R')"
B_ROWS = "b as (select l_partkey as p, l_suppkey as s from lineitem where l_returnflag = 'R')"


def _ab(spark, sf):
    line = V.table(spark, sf, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return [line.where(side).select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")) for side in (~returned, returned)]


@query("set_difference", f"with {A_ROWS}, {B_ROWS} select * from a except select * from b")
def _set_difference(spark, sf):
    return Z.set_difference(*_ab(spark, sf))


@query("union", f"with {A_ROWS}, {B_ROWS} select * from b union all (select * from a except select * from b)")
def _union(spark, sf):
    return Z.union(*_ab(spark, sf))


@query("real_fake_dataset", f"""with u as (select doc_id as id, text, 1 as label from documents union all select item_id, text, 0 from benchmark),
p as (select *, row_number() over (order by {h60("label || '|' || id", 6)}, label, id) - 1 as position from u)
select id, label, length(text) as chars, position, case when position < floor((select count(*) from u) * 0.9::double) then 'train' else 'test' end as split from p""")
def _real_fake(spark, sf):
    real = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    fake = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = Z.real_fake_dataset(real.select("id", F.char_length("text").cast("long").alias("chars")),
                            fake.select("id", F.char_length("text").cast("long").alias("chars")), ["id"], seed=6)
    return d.select("id", "label", "chars", "position", "split")


@query("merge_config", f"""with {V.TRIALS} select trial, 'u=' || u || ';a=' || case when cast(p as int) % 2 = 0 then 'x' else a end || ';p=' || p || ';extra=1' as config from trials""")
def _merge_config(spark, sf):
    t = V.trials(spark, sf)
    override = F.when(F.col("config")["p"].cast("int") % 2 == 0, F.create_map(F.lit("a"), F.lit("x"), F.lit("extra"), F.lit("1"))).otherwise(
        F.create_map(F.lit("extra"), F.lit("1")))
    m = t.select("trial", Z.merge_config(F.col("config"), override).alias("m"))
    return m.select("trial", F.concat(*[x for k in ["u", "a", "p", "extra"] for x in (F.lit(("" if k == "u" else ";") + k + "="), F.col("m")[k])]).alias("config"))
