"""The same queries as SQL over the same tables: ``name -> SQL text``."""

from __future__ import annotations

from registry.rounding import dec_sql as dec
from registry.rounding import sig_sql as sig

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPY = (
    "(select l_returnflag, case when l_linenumber % 7 <> 0 then l_quantity end qty,"
    " case when l_suppkey % 5 <> 0 then l_extendedprice end price,"
    " case when l_partkey % 3 <> 0 then l_discount end discount, l_tax from lineitem)"
)
GAPPY_COLUMNS = ["qty", "price", "discount", "l_tax"]


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


def entropy_sql(source: str, col: str, by: str = "'x'") -> str:
    """(g, h): histogram entropy of one column per group."""
    return f"""
    select g, sum(case when w > 0 then -(c * 1.0 / n) * ln((c * 1.0 / n) / w) else 0 end) h, max(nb) nb from (
      select g, k, count(*) c, max(n) n, max(w) w, max(nb) nb from (
        select p.g, m.n, m.nb, (mx - mn) / nb w,
               case when mx - mn < 2.220446049250313e-16 then 0 else least(floor((x - mn) / ((mx - mn) / nb)), nb - 1) end k
        from (select {by} g, coalesce({col}::double, 0.0) x from {source}) p
        join (select g, n, mn, mx,
                     case when q3 - q1 > 2.220446049250313e-16
                          then greatest(ceil((mx - mn) / (2 * (q3 - q1) * power(n, -1.0 / 3))), 2) else ceil(log2(n)) + 1 end nb
              from (select g, max(n) n, min(x) mn, max(x) mx, max(case when rn = n // 4 + 1 then x end) q1,
                           max(case when rn = (3 * n) // 4 + 1 then x end) q3
                    from (select g, x, row_number() over (partition by g order by x) rn, count(*) over (partition by g) n
                          from (select {by} g, coalesce({col}::double, 0.0) x from {source})) group by g)) m on p.g = m.g)
      group by g, k) group by g"""


def profile_sql(source: str, columns: list[str], by: str | None = None, unique: bool = False) -> str:
    parts = []
    for c in columns:
        x = f"{c}::double"
        stats = [
            f"'{c}' as \"column\"",
            f"count({c}) as count",
            f"count(*) - count({c}) as missing_count",
            f"{sig(f'(count(*) - count({c})) * 1.0 / count(*)')} as missing_rate",
        ]
        values = {
            "mean": f"avg({x})",
            "variance": f"coalesce(var_samp({x}), 0)",
            "std_dev": f"coalesce(stddev_samp({x}), 0)",
            "min": f"min({x})",
            "q25": f"quantile_cont({x}, 0.25)",
            "median": f"quantile_cont({x}, 0.5)",
            "q75": f"quantile_cont({x}, 0.75)",
            "max": f"max({x})",
        }
        stats += [f"{sig(v)} as {k}" for k, v in values.items()]
        stats += [
            f"{dec(f'coalesce(skewness({x}), 0)', 6)} as skewness",
            f"{dec(f'coalesce(kurtosis({x}), 0)', 6)} as kurtosis",
            f"{sig(f'sum(case when {c} = 0 then 1.0 else 0.0 end) / count(*)')} as sparsity",
        ]
        if unique:
            stats.append(f"count(distinct {c}) as unique_count")
        key = by or "'x'"
        stat_names = [s.rsplit(" as ", 1)[1] for s in stats]
        shown = ", ".join(f"s.{n}" for n in ([by] if by else []) + stat_names)
        parts.append(
            f"select {shown}, {dec('e.h', 8)} as entropy from (select {key} as g, {(by + ',') if by else ''} {', '.join(stats)} from {source} t group by {by or '1'}) s"
            f" join ({entropy_sql(source, c, key)}) e on s.g = e.g"
        )
    return union(parts)


def per_column(source: str, columns: list[str], stats: dict[str, str], by: str | None = None) -> str:
    """One aggregate row per column; ``{x}`` in a statistic is the column."""
    lead = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return union(
        [
            f"select {lead}'{c}' as \"column\", " + ", ".join(f"{v.format(x=f'{c}::double')} as {k}" for k, v in stats.items()) + f" from {source} t{tail}"
            for c in columns
        ]
    )


QUARTILES = {
    "min": sig("min({x})"),
    "q25": sig("quantile_cont({x}, 0.25)"),
    "median": sig("quantile_cont({x}, 0.5)"),
    "q75": sig("quantile_cont({x}, 0.75)"),
    "max": sig("max({x})"),
}


def matrix_sql(source: str, columns: list[str], value: str, by: str | None = None) -> str:
    lead, tail = (f"{by}, ", f" group by {by}") if by else ("", "")
    return union(
        [
            f"select {lead}{i} as i, {j} as j, '{a}' as column_i, '{b}' as column_j, {value.format(a=a, b=b, same=int(i == j))} as value from {source} t{tail}"
            for i, a in enumerate(columns)
            for j, b in enumerate(columns)
        ]
    )


CORRELATION = "case when {same} = 1 then 1.0 else coalesce(covar_samp({a}::double, {b}::double) / nullif(sqrt(var_samp({a}::double) * var_samp({b}::double)), 0), 0) end"


def pairs_of(columns: list[str], source: str) -> str:
    return f"select i, j, column_i, column_j, value from ({matrix_sql(source, columns, CORRELATION)})"


TWO_COLUMN = """
with m as (select avg(a) ma, avg(b) mb, stddev_pop(a) sa, stddev_pop(b) sb,
                  covar_samp(a, b) / sqrt(var_samp(a) * var_samp(b)) r from t),
     z as (select t.*, (a - ma) / sa za, (b - mb) / sb zb, sign(r) g, ma, mb, sa, sb, r from t, m)
"""
PRICE_QTY_T = "with t as (select l_orderkey k, l_linenumber line, l_extendedprice a, l_quantity b from lineitem), " + TWO_COLUMN.strip()[5:]
LOADINGS = (
    "select 1 component, 1 + abs(r) eigenvalue, 'l_extendedprice' c, sqrt(0.5) loading from m union all select 1, 1 + abs(r), 'l_quantity', sign(r) * sqrt(0.5) from m"
    " union all select 2, 1 - abs(r), 'l_extendedprice', sqrt(0.5) from m union all select 2, 1 - abs(r), 'l_quantity', -sign(r) * sqrt(0.5) from m"
)

SERIES = (
    "s as (select event_type g, value x, row_number() over (partition by event_type order by ts, event_id) - 1 t,"
    " count(*) over (partition by event_type) n from events)"
)
DETRENDED = (
    "f as (select g, regr_slope(x, t) b, regr_intercept(x, t) a from s group by g),"
    " d as (select s.g, t, n, x - (a + b * t) x from s join f on s.g = f.g)"
)


def acf_sql(max_lag: int) -> str:
    return f"""
    st as (select g, avg(x) mu, var_pop(x) v, count(*) n from s group by g),
    acf as (select u.g, k lag, sum((u.x - mu) * (w.x - mu)) / max(st.n) / max(v) r
            from s u join range(1, {max_lag + 1}) q(k) on true join s w on w.g = u.g and w.t = u.t + k join st on st.g = u.g group by u.g, k)"""


def mi_sql(max_lag: int) -> str:
    return f"""
    p as (select u.g, k lag, u.x u, w.x v from s u join range(1, {max_lag + 1}) q(k) on true join s w on w.g = u.g and w.t = u.t + k),
    pr as (select g, lag, count(*) n, min(u) ul, max(u) uh, min(v) vl, max(v) vh, greatest(ceil(sqrt(count(*))), 2) nb from p group by g, lag),
    pj as (select p.g, p.lag, n, least(floor((u - ul) / (uh - ul) * (nb - 1) + 0.5), nb - 1) ku,
                  least(floor((v - vl) / (vh - vl) * (nb - 1) + 0.5), nb - 1) kv from p join pr on p.g = pr.g and p.lag = pr.lag),
    pc as (select g, lag, n, ku, kv, count(*) c from pj group by all),
    pd as (select *, sum(c) over (partition by g, lag, ku) cu, sum(c) over (partition by g, lag, kv) cv from pc),
    mi as (select g, lag, greatest(sum(c * 1.0 / n * ln(c * 1.0 * n / (cu * cv))), 0) mi from pd group by g, lag)"""


def near_sql(source: str, eps: float) -> str:
    return f"""
    h as (select u.g, u.t, max(u.n) n, count(*) c from {source} u join {source} w on u.g = w.g and abs(u.x - w.x) < {eps} group by u.g, u.t),
    c1 as (select g, max(n) n, (sum(c) - max(n)) * 1.0 / (max(n) * (max(n) - 1)) c1, sum(c * c * 1.0) / power(max(n), 3) k from h group by g)"""


def vector_sql(source: str, dim: int, tau: int = 1) -> str:
    """v(g, i, n, x0..): delay vectors."""
    cols = ", ".join(f"lead(x, {k * tau}) over (partition by g order by t) x{k}" for k in range(1, dim))
    return f"v as (select * from (select g, t i, n, x x0{', ' + cols if cols else ''} from {source}) where i < n - {(dim - 1) * tau})"


def cm_sql(dim: int, eps: float) -> str:
    near = " and ".join(f"abs(a.x{k} - b.x{k}) < {eps}" for k in range(dim))
    return f"""cm as (select a.g, count(*) * 2.0 / ((max(a.n) - {dim - 1}) * (max(a.n) - {dim})) cm from v a join v b on a.g = b.g and a.i < b.i and {near} group by a.g)"""


def bds_sql(m: int) -> str:
    middle = " + ".join(f"power(k, {m - j}) * power(c1, {2 * j})" for j in range(1, m))
    return f"""
    with {SERIES}, {DETRENDED}, {near_sql('d', 40.0)}, {vector_sql('d', m)}, {cm_sql(m, 40.0)},
    q as (select c1.g, n, c1, cm, k, 4 * (power(k, {m}) + 2 * ({middle}) + {(m - 1) ** 2} * power(c1, {2 * m}) - {m * m} * k * power(c1, {2 * m - 2})) v from c1 join cm on c1.g = cm.g),
    z as (select *, coalesce(case when v > 0 then sqrt(n - {m - 1}) * (cm - power(c1, {m})) / sqrt(v) end, 0) st from q),
    e as (select *, 1.0 / (1.0 + 0.3275911 * abs(st) / sqrt(2.0)) tt from z)
    select g event_type, {dec('c1', 10)} c1, {dec('cm', 10)} cm, {dec('k', 10)} k, {dec('st', 7)} as statistic,
      {dec('2 * (1 - 0.5 * (1 + (1 - (((((1.061405429 * tt - 1.453152027) * tt) + 1.421413741) * tt - 0.284496736) * tt + 0.254829592) * tt * exp(-st * st / 2))))', 7)} p_value
    from e"""


def pacf_sql(max_lag: int) -> str:
    """dl<max_lag>(g, p1, ..): partial autocorrelations of acf(g, lag, r), order by order."""
    ctes = ["dl0 as (select g, " + ", ".join(f"max(r) filter (lag = {k}) r{k}" for k in range(1, max_lag + 1)) + " from acf group by g)"]
    for k in range(1, max_lag + 1):
        top = " - ".join([f"r{k}", *[f"a{k - 1}_{j} * r{k - j}" for j in range(1, k)]])
        bottom = " - ".join(["1", *[f"a{k - 1}_{j} * r{j}" for j in range(1, k)]])
        rest = "".join(f", a{k - 1}_{j} - p{k} * a{k - 1}_{k - j} a{k}_{j}" for j in range(1, k))
        ctes += [f"dn{k} as (select *, ({top}) / ({bottom}) p{k} from dl{k - 1})", f"dl{k} as (select *, p{k} a{k}_{k}{rest} from dn{k})"]
    return ", ".join(ctes)


def memory_sql(max_lag: int) -> str:
    lags = range(1, max_lag + 1)
    wide = "mw as (select g, sum(mi) total, " + ", ".join(f"max(mi) filter (lag = {k}) m{k}" for k in lags) + " from mi group by g)"
    out = ", ".join([f"{dec(f'p{k}', 8)} as pacf{k}" for k in lags] + [f"{dec(f'm{k}', 8)} as mi{k}" for k in lags])
    longest = "greatest(" + ", ".join(f"case when abs(p{k}) > 2 / sqrt(n) then {k} else 0 end" for k in lags) + ")::int"
    return (
        f"with {SERIES}, {acf_sql(max_lag)}, {pacf_sql(max_lag)}, {mi_sql(max_lag)}, {wide}, ns as (select g, count(*) n from s group by g)"
        f" select dl.g as event_type, {out}, {dec('total', 8)} as active_information_storage, {longest} as memory_length"
        f" from dl{max_lag} dl join mw on mw.g = dl.g join ns on ns.g = dl.g"
    )


def surrogate_sql(surrogates: int) -> str:
    """AR(1) driven by residuals in the order of a hash, folded row after row."""
    step, value = "(a.y * phi + z.y)", "(mu + a.y)"
    return f"""
    with {SERIES}, {DETRENDED}, m as (select g, avg(x) mu from d group by g),
    p as (select u.g, w.t, w.n, u.x y, w.x x, mu from d u join d w on w.g = u.g and w.t = u.t + 1 join m on m.g = u.g),
    model as (select g, max(n) n, max(mu) mu, sum((x - mu) * (y - mu)) / sum((y - mu) * (y - mu)) phi, avg(x * x * y - x * y * y) real from p group by g),
    o as (select p.g, b, list((x - p.mu) - phi * (y - p.mu) order by ('0x' || substr(md5('12345:' || b || ':' || t), 1, 15))::bigint, t) es
          from p join model on model.g = p.g cross join range({surrogates}) q(b) group by p.g, b),
    st as (select o.g, list_reduce(list_transform(es, lambda e: {{'y': e, 's': 0.0::double}}),
             lambda a, z: {{'y': {step}, 's': a.s + (mu + {step}) * {value} * ({step} - a.y)}}).s / (n - 2) v from o join model on model.g = o.g),
    f2 as (select g, avg(v) sm, stddev_samp(v) sd from st group by g)
    select model.g as event_type, {dec('real', 3)} as statistic_real, {dec('sm', 3)} as surrogate_mean, {dec('sd', 3)} as surrogate_std,
      {dec('(real - sm) / sd', 5)} as z_score, abs((real - sm) / sd) > 2 as is_nonlinear from model join f2 on f2.g = model.g"""


STEPS = "(select l_orderkey, l_linenumber, (l_linenumber > 3)::int::double late, (l_returnflag = 'R')::int::double back, late * back \"both\" from lineitem)"


def gap_sql() -> str:
    held = "('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::bigint % 1000 < 250"
    linear = "1 - sum(power(late - (a + b * l_linenumber), 2)) / (var_pop(late) * count(*))"
    return (
        f"with t as (select *, {held} held from {STEPS}), f as (select regr_slope(late, l_linenumber) b, regr_intercept(late, l_linenumber) a from t where not held),"
        f" r as (select {linear} lin from t, f where held) select {dec('lin', 6)} as r2_linear, 1.0::double as r2_nonlinear, {dec('1 - lin', 6)} as nonlinearity_gap from r"
    )


def interaction_sql() -> str:
    return (
        f'with c as (select corr("both", late) a, corr("both", back) b, corr(late, back) d from {STEPS})'
        f" select {dec('1 - (a * a + b * b - 2 * a * b * d) / (1 - d * d)', 6)} as interaction_strength from c"
    )


def equal_columns_sql(source: str, kinds: dict[str, list[str]]) -> str:
    """Every pair of columns of one type, compared row by row."""
    pairs = [(a, b) for names in kinds.values() for i, a in enumerate(names) for b in names[i + 1 :]]
    tests = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'same': bool_and({a} is not distinct from {b})}}" for a, b in pairs)
    return f"select p.a as column_a, p.b as column_b from (select unnest([{tests}]) p from {source}) where p.same"


def fnn_sql(dims: int) -> str:
    """fnn(g, dim, tau, nc, share) for plan(g, n, tau)."""
    values = ", ".join(f"lead(s.x, {k} * tau::int) over (partition by s.g order by s.t) x{k}" for k in range(dims + 1))
    ctes = [f"e as (select s.g, s.t i, plan.n n, tau, {values} from s join plan on plan.g = s.g)"]
    parts = []
    for dim in range(1, dims + 1):
        dist = " + ".join(f"power(a.x{k} - b.x{k}, 2)" for k in range(dim))
        ctes.append(f"e{dim} as (select *, n - {dim} * tau nc from e where i < n - {dim} * tau)")
        parts.append(
            f"""select g, {dim} dim, max(tau) tau, max(nc) nc, avg(case when abs(own - other) / d > 15.0 then 1.0 else 0.0 end) share from (
              select a.g, a.i, max(a.tau) tau, max(a.nc) nc, max(a.x{dim}) own, min_by(b.x{dim}, (sqrt({dist}), b.i)) other, min(sqrt({dist})) d
              from e{dim} a join e{dim} b on a.g = b.g and a.i <> b.i
              where a.i % greatest(a.nc // least(a.nc, 200), 1) = 0 and {dist} > 0 group by a.g, a.i) group by g"""
        )
    return ", ".join(ctes) + ", fnn as (" + union(parts) + ")"


def lyapunov_sql() -> str:
    gap = "+".join(f"power(a.x{k} - b.x{k}, 2)" for k in range(3))
    return f"""
    with {SERIES}, {vector_sql('s', 3)},
    nn as (select a.g, a.i, a.n, min_by(b.i, (sqrt({gap}), b.i)) j from v a join v b on a.g = b.g and abs(a.i - b.i) >= 3 where {gap} > 0 group by a.g, a.i, a.n),
    st as (select nn.*, unnest(range(0, least(greatest(((n - 2) // 4) // 10, 5), (n - 2) // 4))) k from nn),
    dv as (select st.g, k, avg(ln(sqrt({gap}))) y from st join v a on a.g = st.g and a.i = st.i + k join v b on b.g = st.g and b.i = st.j + k where {gap} > 0 group by st.g, k)
    select g event_type, {dec('regr_slope(y, k)', 9)} lyapunov_exponent from dv group by g"""


def outlier_sql(source: str, columns: list[str], low: str, high: str, by: str | None = None) -> str:
    key = by or "'x'"
    parts = []
    for c in columns:
        lead = f"{by}, " if by else ""
        parts.append(
            f"select {lead}'{c}' as \"column\", {sig('max(lo)')} as lower, {sig('max(hi)')} as upper, count(*) filter (where {c} < lo or {c} > hi) as outliers,"
            f" {sig(f'count(*) filter (where {c} < lo or {c} > hi) * 1.0 / count({c})')} as outlier_rate"
            f" from {source} t join (select {key} g, {low.format(x=c)} lo, {high.format(x=c)} hi from {source} u group by {key if by else '1'}) b on {('t.' + by) if by else key} = b.g"
            + (f" group by {by}" if by else "")
        )
    return union(parts)


IQR_LOW = "quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"
IQR_HIGH = "quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"


def information_sql(source: str, a: str, b: str) -> str:
    """mi of bin columns a, b in ``source``."""
    return f"""(select greatest(sum(c * 1.0 / n * ln(c * 1.0 * n / (ca * cb))), 0) from (
        select c, sum(c) over () n, sum(c) over (partition by ka) ca, sum(c) over (partition by kb) cb
        from (select {a} ka, {b} kb, count(*) c from {source} group by 1, 2)))"""


def binned(x: str, bins: str = "nb") -> str:
    return f"least(floor(({x} - {x}_lo) / ({x}_hi - {x}_lo) * ({bins} - 1) + 0.5), {bins} - 1)"


MI_PRICE = (
    "(select p.*, x_lo, x_hi, y_lo, y_hi, nb from (select l_extendedprice x, l_quantity y from lineitem) p, "
    "(select min(l_extendedprice) x_lo, max(l_extendedprice) x_hi, min(l_quantity) y_lo, max(l_quantity) y_hi, greatest(ceil(sqrt(count(*))), 2) nb from lineitem) r)"
)
MI_FLAG = (
    f"(select p.*, x_lo, x_hi, nb from (select price x, l_returnflag y from {GAPPY} where price is not null) p, "
    f"(select min(price) x_lo, max(price) x_hi, greatest(ceil(sqrt(count(price))), 2) nb from {GAPPY}) r)"
)


def regime_sql() -> str:
    def rss(side: str) -> str:
        f = f" filter (where {side})"
        return f"((count(*){f} * 1.0) * var_pop(x){f} - coalesce(power(covar_pop(x, y){f} * count(*){f}, 2) / nullif(var_pop(y){f} * count(*){f}, 0), 0))"

    def ll(side: str) -> str:
        n = f"(count(*) filter (where {side}))"
        return f"(-{n} / 2.0 * (ln(2 * pi() * {rss(side)} / {n}) + 1))"

    grid = ", ".join(str(0.15 + 0.7 * k / 14) for k in range(15))
    return f"""
    with {SERIES}, p as (select u.g, u.x y, w.x x from s u join s w on w.g = u.g and w.t = u.t + 1),
    c as (select g, unnest(quantile_cont(y, [{grid}])) c from p group by g),
    sc as (select p.g, c, {ll('y <= c')} + {ll('y > c')} - {ll('true')} d from p join c on p.g = c.g group by p.g, c
           having count(*) filter (where y <= c) >= 10 and count(*) filter (where y > c) >= 10)
    select g event_type, {dec('max_by(c, d)', 6)} threshold, {dec('max(d)', 5)} delta_log_likelihood from sc group by g"""


def ranks_sql() -> str:
    cols = ", ".join(
        f"case when {c} is not null then rank() over (partition by {c} is null order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 end {c}" for c in GAPPY_COLUMNS
    )
    return f"(select {cols} from {GAPPY})"


def all_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["profile_lineitem"] = profile_sql("lineitem", LINEITEM)
    q["profile_range_sort_lineitem"] = q["profile_lineitem"]
    q["profile_orders_by_status"] = profile_sql("orders", ["o_custkey", "o_totalprice"], "o_orderstatus")
    q["profile_with_nulls"] = profile_sql(GAPPY, GAPPY_COLUMNS)
    q["profile_summary_customer"] = profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], unique=True)
    q["row_count_by_flag"] = "select l_returnflag, l_linestatus, count(*) as rows from lineitem group by all"
    q["column_types_lineitem"] = union(
        [
            f"select '{c}' as \"column\", 'f64' as type, case typeof(any_value({c})) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' else 'double' end as spark_type, count({c}) as count from lineitem"
            for c in LINEITEM
        ]
    )
    q["column_count_lineitem"] = "select count(*) as rows, 8::bigint as columns from lineitem"
    q["mean_by_flag"] = per_column("lineitem", ["l_extendedprice", "l_quantity"], {"mean": sig("avg({x})")}, "l_returnflag")
    q["variance_customer"] = per_column("customer", ["c_custkey", "c_nationkey", "c_acctbal"], {"variance": sig("var_samp({x})")}, "c_mktsegment")
    q["std_dev_part"] = per_column("part", ["p_partkey", "p_size", "p_retailprice"], {"std_dev": sig("stddev_samp({x})")})
    q["extrema_events"] = per_column("events", ["event_id", "user_id", "value"], {"min": sig("min({x})"), "max": sig("max({x})")}, "event_type")
    q["median_events"] = per_column("events", ["value"], {"median": sig("median({x})")}, "event_type")
    q["quantiles_orders"] = per_column("orders", ["o_orderkey", "o_custkey", "o_totalprice"], QUARTILES)
    q["quantiles_range_sort_by_flag"] = per_column(GAPPY, ["qty", "price", "discount"], QUARTILES, "l_returnflag")
    q["skewness_events"] = per_column("events", ["value"], {"skewness": dec("skewness({x})", 6)}, "event_type")
    q["kurtosis_events"] = per_column("events", ["value"], {"kurtosis": dec("kurtosis({x})", 6)}, "event_type")
    q["sparsity_with_nulls"] = per_column(GAPPY, GAPPY_COLUMNS, {"sparsity": sig("sum(case when {x} = 0 then 1.0 else 0.0 end) / count(*)")})
    entropy = lambda source, cols, by=None: union(
        [f"select {('g as ' + by + ', ') if by else ''}'{c}' as \"column\", nb::bigint as bins, {dec('h', 8)} as entropy from ({entropy_sql(source, c, by or chr(39) + 'x' + chr(39))})" for c in cols]
    )
    q["entropy_lineitem"] = entropy("lineitem", LINEITEM)
    q["entropy_with_nulls_by_flag"] = entropy(GAPPY, ["qty", "price", "discount"], "l_returnflag")
    q["entropy_range_sort_events"] = entropy("events", ["value"], "event_type")
    q["unique_count_lineitem"] = per_column("lineitem", LINEITEM, {"unique_count": "count(distinct {x})"})
    q["unique_count_by_flag"] = union(
        [f"select l_returnflag, '{c}' as \"column\", count(distinct {c}) as unique_count from lineitem group by 1" for c in ("l_partkey", "l_linestatus", "l_discount")]
    )
    covar = "coalesce(covar_samp({a}::double, {b}::double), 0)"
    q["covariance_lineitem"] = matrix_sql("lineitem", LINEITEM, sig(covar))
    q["covariance_with_nulls"] = matrix_sql(GAPPY, GAPPY_COLUMNS, sig(covar), "l_returnflag")
    day = "(select *, strftime(date_trunc('day', ts), '%Y-%m-%d') as day from events)"
    q["profile_stream_events"] = union(
        [
            f"select event_type, '{c}' as \"column\", count(*) as rows, {sig(f'coalesce(avg({c}::double), 0)')} as mean, {sig(f'coalesce(var_samp({c}::double), 0)')} as variance,"
            f" {dec(f'coalesce(skewness({c}::double), 0)', 6)} as skewness, {sig(f'sum(case when {c} = 0 then 1.0 else 0.0 end) / count(*)')} as sparsity, day from {day} group by day, event_type"
            for c in ("value", "user_id")
        ]
    )
    q["covariance_stream_events"] = union(
        [
            f"select {i} as i, {j} as j, {dec(f'coalesce(covar_samp({a}::double, {b}::double), 0)', 6)} as value, day from {day} group by day"
            for i, a in enumerate(("value", "user_id"))
            for j, b in enumerate(("value", "user_id"))
        ]
    )
    q["covariance_embeddings_by_label"] = (
        f"select label, i::int as i, j::int as j, {dec('coalesce(covar_samp(embedding[i + 1]::double, embedding[j + 1]::double), 0)', 9)} as value from embeddings, range(64) a(i), range(64) b(j) group by label, i, j"
    )
    q["covariance_wide_embeddings"] = (
        f"select i::int as i, j::int as j, {dec('covar_samp(embedding[i + 1]::double, embedding[j + 1]::double)', 9)} as value from embeddings, range(64) a(i), range(64) b(j) group by i, j"
    )
    q["correlation_lineitem"] = matrix_sql("lineitem", LINEITEM, dec(CORRELATION, 8))
    q["correlation_with_nulls"] = matrix_sql(GAPPY, GAPPY_COLUMNS, dec(CORRELATION, 8))
    q["correlation_pairs_lineitem"] = f"select column_i, column_j, {dec('value', 8)} as correlation from ({pairs_of(LINEITEM, 'lineitem')}) where i < j and abs(value) >= 0.004"
    q["correlation_with_price"] = f"select column_i as \"column\", {dec('value', 8)} as correlation from ({pairs_of(LINEITEM, 'lineitem')}) where column_j = 'l_extendedprice' and column_i <> 'l_extendedprice'"
    q["spearman_lineitem"] = matrix_sql(ranks_sql(), GAPPY_COLUMNS, dec(CORRELATION, 8))
    q["eigen_price_qty"] = f"{PRICE_QTY_T} select component, {dec('eigenvalue', 8)} as eigenvalue, c as \"column\", {dec('loading', 8)} as loading from ({LOADINGS})"
    q["pca_price_qty"] = (
        f"{PRICE_QTY_T} select component, {dec('eigenvalue', 8)} as eigenvalue, {dec('eigenvalue / 2', 8)} as ratio,"
        f" {dec('case when component = 1 then eigenvalue / 2 else 1.0 end', 8)} as cumulative, c as \"column\", {dec('loading', 8)} as loading from ({LOADINGS})"
    )
    q["pca_spectrum_lineitem"] = (
        f"select 8::bigint as components, {dec('sum(case when i = j then value end)', 8)} as trace, {dec('sum(value * value)', 8)} as energy, {dec('8.0', 8)} as norms from ({pairs_of(LINEITEM, 'lineitem')})"
    )
    q["project_price_qty"] = f"{PRICE_QTY_T} select k, line, {dec('(za + g * zb) / sqrt(2)', 7)} as \"PC1\", {dec('(za - g * zb) / sqrt(2)', 7)} as \"PC2\" from z"
    q["project_with_nulls"] = (
        f"with m as (select avg(coalesce(price, 0)) ma, stddev_pop(coalesce(price, 0)) sa, avg(l_tax) mb, stddev_pop(l_tax) sb, sign(covar_samp(price, l_tax)) g from {GAPPY})"
        f" select l_returnflag, {sig('sum(abs(((coalesce(price, 0) - ma) / sa + g * (l_tax - mb) / sb) / sqrt(2)))')} as size, count(*) as rows from {GAPPY}, m group by l_returnflag"
    )
    q["reconstruct_one_component"] = (
        f"{PRICE_QTY_T} select k, line, {dec('(za + g * zb) / 2 * sa + ma', 4)} as l_extendedprice, {dec('g * (za + g * zb) / 2 * sb + mb', 6)} as l_quantity from z"
    )
    q["reconstruct_full_lineitem"] = (
        "select l_orderkey, l_linenumber, " + ", ".join(f"{dec(c, 5)} as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " from lineitem"
    )
    q["design_matrix_regression"] = (
        "select l_orderkey, l_linenumber::double as x0, l_quantity as x1, l_discount as x2, l_tax as x3, l_extendedprice as label from lineitem"
    )
    q["design_matrix_binary"] = "select doc_id::double as x0, toxic::double as x1, quality::double as label from labels"
    q["design_matrix_multi"] = f"select coalesce(price, 0.0)::double as x0, l_tax as x1, coalesce(qty, 0.0)::double as label from {GAPPY}"
    q["detrend_events"] = f"with {SERIES}, {DETRENDED} select g as event_type, t, {dec('x', 6)} as x from d"
    q["time_reversal_events"] = (
        f"with {SERIES} select u.g as event_type, {dec('avg(w.x * w.x * u.x - w.x * u.x * u.x)', 3)} as asymmetry from s u join s w on w.g = u.g and w.t = u.t + 1 group by u.g"
    )
    q["autocorrelation_events"] = f"with {SERIES}, {acf_sql(10)} select g as event_type, lag::int as lag, {dec('r', 8)} as autocorrelation from acf"
    users = SERIES.replace("event_type g", "user_id g").replace("partition by event_type", "partition by user_id")
    kept = f"s0 as (select * from s_all), s as (select * from s0)"
    q["autocorrelation_by_user"] = (
        f"with {users.replace('s as (', 's_all as (', 1)}, {kept}, {acf_sql(3)} select g as user_id, lag::int as lag, {dec('r', 8)} as autocorrelation from acf"
    )
    pacf = "a1.r r1, a2.r r2, (a2.r - a1.r * a1.r) / (1 - a1.r * a1.r) p2"
    two = f"pc2 as (select a1.g, {pacf} from acf a1 join acf a2 on a1.g = a2.g and a1.lag = 1 and a2.lag = 2)"
    q["partial_autocorrelation_events"] = (
        f"with {SERIES}, {acf_sql(2)}, {two} select g as event_type, 1::int as lag, {dec('r1', 8)} as partial_autocorrelation from pc2"
        f" union all select g, 2::int, {dec('p2', 8)} from pc2"
    )
    single = SERIES.replace("event_type g", "1 g").replace("partition by event_type ", "")
    single = single.replace("over (partition by event_type)", "over ()")
    q["delay_information_events"] = f"with {single}, {mi_sql(8)} select lag::int as lag, {dec('mi', 8)} as mutual_information from mi"
    q["dependence_events"] = (
        f"with {SERIES}, {acf_sql(10)}, {mi_sql(10)}, b as (select acf.g, acf.lag, r, mi, mi > 1.5 * -0.5 * ln(1 - r * r) hit from acf join mi on acf.g = mi.g and acf.lag = mi.lag)"
        f" select g as event_type, lag::int as lag, {dec('r', 8)} as autocorrelation, {dec('mi', 8)} as mutual_information, bool_or(hit) over (partition by g) as nonlinear_dominance from b"
    )
    q["memory_events"] = memory_sql(10)
    q["surrogate_events"] = surrogate_sql(100)
    q["correlation_integral_events"] = f"with {SERIES}, {vector_sql('s', 3)}, {cm_sql(3, 25.0)} select g as event_type, {dec('cm', 10)} as correlation_integral from cm"
    q["triple_correlation_events"] = f"with {SERIES}, {near_sql('s', 25.0)} select g as event_type, {dec('k', 10)} as triple_correlation from c1"
    q["bds_events"] = bds_sql(3)
    q["bds_rank_boxes_events"] = bds_sql(3)
    q["lyapunov_events"] = lyapunov_sql()
    q["lyapunov_grid_events"] = lyapunov_sql()
    q["delay_information_by_user"] = (
        f"with {users.replace('s as (', 's_all as (', 1)}, s as (select * from s_all), {mi_sql(3)} select g as user_id, lag::int as lag, {dec('mi', 8)} as mutual_information from mi"
    )
    q["ar1_fit_events"] = (
        f"with {SERIES}, {DETRENDED}, m as (select g, avg(x) mu from d group by g), p as (select u.g, u.x y, w.x x, mu from d u join d w on w.g = u.g and w.t = u.t + 1 join m on m.g = u.g)"
        f" select g as event_type, {dec('max(mu)', 6)} as mean, {dec('sum((x - mu) * (y - mu)) / sum((y - mu) * (y - mu))', 8)} as phi, {dec('avg(x * x * y - x * y * y)', 3)} as asymmetry from p group by g"
    )
    q["false_neighbours_events"] = (
        f"with {SERIES}, plan as (select g, max(n) n, 2 tau from s group by g), {fnn_sql(3)} select g as event_type, dim, tau::bigint as tau, {dec('share', 9)} as false_share from fnn"
    )
    q["delay_embedding_events"] = (
        f"with {SERIES}, {mi_sql(50)}, mm as (select g, lag, mi, lag(mi) over (partition by g order by lag) pm, lead(mi) over (partition by g order by lag) nm from mi),"
        " plan as (select s.g, max(s.n) n, coalesce((select min(lag) from mm where mm.g = s.g and mi < pm and mi <= nm), 1) tau from s group by s.g),"
        f" {fnn_sql(10)} select g as event_type, max(tau)::bigint as optimal_delay, coalesce(min(case when share < 0.01 then dim end), max(dim))::int as embedding_dimension from fnn where nc >= 20 group by g"
    )
    odd = "(select doc_id, nullif(lang, 'en') lang, case when doc_id % 4 <> 0 then source end source, n_chars from documents)"
    q["missing_documents"] = union(
        [
            f"select '{c}' as \"column\", count(*) - count({c}) as missing_count, {sig(f'(count(*) - count({c})) * 1.0 / count(*)')} as missing_rate from {odd}"
            for c in ("doc_id", "lang", "source", "n_chars")
        ]
    )
    cells = " + ".join(f"count(*) - count({c})" for c in ["l_returnflag", *GAPPY_COLUMNS])
    q["dataset_missing_rate_lineitem"] = f"select {sig(f'({cells}) * 1.0 / (count(*) * 5)')} as missing_rate from {GAPPY}"
    q["duplicate_rows_lineitem"] = (
        "select sum(c)::bigint as rows, count(*) as distinct_rows, count(*) filter (where c > 1) as repeated_groups, (sum(c) - count(*))::bigint as duplicate_rows"
        " from (select count(*) c from lineitem group by l_quantity, l_discount, l_tax, l_returnflag)"
    )
    q["repeated_documents"] = "select md5(text) as digest, lang, count(*) as copies from documents group by text, lang having count(*) > 1"
    q["duplicate_columns_lineitem"] = equal_columns_sql(
        "(select *, l_quantity qty_again, l_returnflag flag_again from lineitem)",
        {
            "bigint": ["l_orderkey", "l_partkey", "l_suppkey"],
            "double": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_again"],
            "string": ["l_returnflag", "l_linestatus", "flag_again"],
        },
    )
    q["top_part_types"] = "select p_type as value, count(*) as count from part group by 1 order by 2 desc, 1 limit 10"
    q["top_types_per_brand"] = (
        "select p_brand, p_type as value, count(*) as count, row_number() over (partition by p_brand order by count(*) desc, p_type)::int as rank from part group by 1, 2"
        " qualify row_number() over (partition by p_brand order by count(*) desc, p_type) <= 3"
    )
    share = sig("count(*) * 1.0 / sum(count(*)) over ()")
    q["category_frequency_segments"] = f"select c_mktsegment as value, count(*) as count, {share} as share from customer group by 1"
    q["iqr_outliers_lineitem"] = outlier_sql("lineitem", ["l_quantity", "l_extendedprice", "l_tax"], IQR_LOW, IQR_HIGH)
    q["iqr_outliers_events"] = outlier_sql("events", ["value"], IQR_LOW, IQR_HIGH, "event_type")
    q["outlier_rate_events"] = f"select \"column\", outlier_rate from ({outlier_sql('events', ['value'], IQR_LOW, IQR_HIGH)})"
    q["outlier_rows_events"] = (
        f"select event_id, event_type, value from events join (select event_type g, {IQR_LOW.format(x='value')} lo, {IQR_HIGH.format(x='value')} hi from events group by 1) b on event_type = g where value < lo or value > hi"
    )
    q["zscore_outliers_events"] = outlier_sql("events", ["value"], "avg({x}) - 3 * stddev_samp({x})", "avg({x}) + 3 * stddev_samp({x})", "event_type")
    q["low_variance_lineitem"] = f"select * from ({per_column('lineitem', LINEITEM, {'variance': sig('var_samp({x})')})}) where variance < 0.01"
    q["mutual_information_price"] = (
        f"select 'l_extendedprice' as feature, 'l_quantity' as target, {dec(information_sql(MI_PRICE, binned('x'), binned('y')), 8)} as mutual_information"
    )
    q["mutual_information_flag"] = f"select 'price' as feature, 'l_returnflag' as target, {dec(information_sql(MI_FLAG, binned('x'), 'y'), 8)} as mutual_information"
    q["anova_priority"] = (
        "with c as (select o_orderpriority p, count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) * count(*) w from orders group by 1), gm as (select avg(o_totalprice) a from orders)"
        f" select 'o_totalprice' as feature, 'o_orderpriority' as target, count(*) as classes, sum(n)::bigint as rows,"
        f" {dec('(sum(n * power(m - a, 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*)))', 7)} as f_score from c, gm"
    )

    def kind(table: str, c: str, expr: str) -> str:
        tries = [("numeric", "double"), ("boolean", "boolean"), ("datetime", "timestamp")]
        cases = " ".join(f"when avg(case when try_cast({expr} as {t}) is not null then 1.0 else 0.0 end) >= 0.95 then '{n}'" for n, t in tries)
        return f"select '{c}' as \"column\", case {cases} when count(distinct {expr}) <= greatest(20, 0.05 * count(*)) then 'categorical' else 'text' end as detected_type from {table}"

    q["detect_type_orders"] = union(
        [
            "select c as \"column\", k as detected_type from (values ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('toxic', 'boolean')) v(c, k)",
            kind("orders", "o_orderstatus", "o_orderstatus"),
            kind("orders", "o_orderpriority", "o_orderpriority"),
            kind("orders", "as_text", "o_totalprice::varchar"),
            kind("orders", "day", "strftime(o_orderdate, '%Y-%m-%d')"),
            kind("documents", "text", "text"),
            kind("documents", "lang", "lang"),
            kind("documents", "source", "source"),
            kind("labels", "good", "(quality = 1)::varchar"),
        ]
    )
    spans = per_column("lineitem", LINEITEM, {"range": "max({x}) - min({x})"})
    q["feature_range_lineitem"] = f"select \"column\", {sig('range')} as range from ({spans})"
    q["range_ratio_lineitem"] = f"select {sig('max(range) / min(range) filter (where range <> 0)')} as range_ratio from ({spans})"
    q["class_distribution_quality"] = f"select quality as value, count(*) as count, {share} as share from labels group by 1"
    q["imbalance_toxic"] = (
        f"select count(*) as classes, max(c) as largest, min(c) as smallest, {sig('max(c) * 1.0 / min(c)')} as imbalance_ratio from (select count(*) c from labels where toxic is not null group by toxic)"
    )
    q["information_ratio_orders"] = (
        f"with m as (select {information_sql(MI_PRICE, binned('x'), binned('y'))} mi), r as (select {CORRELATION.format(a='l_quantity', b='l_extendedprice', same=0)} r from lineitem)"
        f" select 'l_quantity' as column_x, 'l_extendedprice' as column_y, {dec('mi', 8)} as mutual_information, {dec('r', 8)} as correlation, {sig('mi / abs(r)')} as information_ratio from m, r"
    )
    q["polynomial_gain_part"] = (
        "with z as (select (p_partkey - avg(p_partkey) over ()) / stddev_pop(p_partkey) over () x, p_retailprice y from part),"
        " c as (select corr(y, x) a, corr(y, x * x) b, corr(x, x * x) d from z), e as (select a * a lin, (a * a + b * b - 2 * a * b * d) / (1 - d * d) pol from c)"
        f" select {dec('lin', 6)} as r2_linear, {dec('pol', 6)} as r2_polynomial, {dec('pol - lin', 6)} as polynomial_gain from e"
    )
    q["nonlinearity_gap_lineitem"] = gap_sql()
    q["interaction_strength_steps"] = interaction_sql()
    chaos = f"select avg(lyapunov_exponent) lyapunov_exponent from ({lyapunov_sql()})"
    parts = {
        "nonlinearity_gap": q["nonlinearity_gap_lineitem"],
        "information_ratio": q["information_ratio_orders"],
        "polynomial_gain": q["polynomial_gain_part"],
        "lyapunov_exponent": chaos,
        "interaction_strength": q["interaction_strength_steps"],
    }
    metrics = ", ".join(f"(select {m} from ({sql})) {m}" for m, sql in parts.items())
    digits = ", ".join(f"{dec(m, 3 if m == 'information_ratio' else 6)} as {m}" for m in parts)
    total = " + ".join(f"{m} * 0.1" if m == "information_ratio" else m for m in parts)
    q["combined_score_steps"] = f"with metrics as (select {metrics}) select {digits}, {dec(total, 3)} as score from metrics"
    q["regime_switching_events"] = regime_sql()
    return q
