"""DuckDB statements that recompute the registered queries independently."""

from __future__ import annotations

from subscope.plans.oracle_base import (
    CATALOG,
    COSINE,
    DIM_CUSTOMER,
    DIM_DATE,
    DIM_TARIFF,
    ENRICHED,
    EXPERIMENT,
    FACT,
    PURCHASES,
    RAW,
    SCORED,
    STAR,
    SUBSCRIBERS,
    cents,
    drift,
    normal_p,
    pick,
    ratio,
    rfm,
    student_p,
    word,
)
from subscope.plans.registry import RAW_RULES
from subscope.sources import generate
from subscope.sources.star import star_constraints
from subscope.sources.tables import LOADS, REFERENCE_END

_RISK = "CASE WHEN churned * 1.0 / NULLIF(n_customers, 0) > 0.25 THEN 'HIGH' " \
        "WHEN churned * 1.0 / NULLIF(n_customers, 0) > 0.15 THEN 'MEDIUM' ELSE 'LOW' END"


def _q6(tenure: str, customers: str, churned: str, weight: str) -> str:
    return f"""WITH {FACT}, {DIM_CUSTOMER}, {DIM_DATE},
h AS (SELECT customer_sk, sum(amount) AS spend, count(*) AS n_tx, min(full_date) AS first_date
      FROM fact JOIN dim_date USING (date_sk) GROUP BY 1),
m AS (SELECT *, {tenure} AS months FROM h),
s AS (SELECT segment_name, {customers} AS n_customers, CAST({churned} AS BIGINT) AS churned,
             {ratio(cents('sum(spend)'), '100 * sum(n_tx)', 2)} AS avg_monthly_spend,
             {ratio(f'sum(months * {weight})', f'sum({weight})', 1)} AS avg_tenure_months
      FROM m JOIN dim_customer USING (customer_sk) GROUP BY 1)
SELECT segment_name, n_customers, churned, {ratio('churned * 100', 'n_customers', 1)} AS churn_rate_pct,
       avg_monthly_spend, avg_tenure_months,
       CAST(rank() OVER (ORDER BY churned * 1.0 / NULLIF(n_customers, 0) DESC NULLS FIRST) AS INT) AS churn_risk_rank,
       {_RISK} AS risk_level
FROM s"""


# completed months from d to 2001-08-01: month difference, less one while the day is not reached
_MONTHS = "((2001 * 12 + 8) - (year(first_date) * 12 + month(first_date)) - CASE WHEN day(first_date) > 1 THEN 1 ELSE 0 END)"


_BINS = "CASE WHEN churn_probability > 0 AND churn_probability <= 0.3 THEN 'Low' " \
        "WHEN churn_probability > 0.3 AND churn_probability <= 0.6 THEN 'Medium' " \
        "WHEN churn_probability > 0.6 AND churn_probability <= 1.0 THEN 'High' END"


def statements() -> dict[str, str]:
    return {
        **_reports(), **_features(), **_boards(), **_statistics(), **_sources(), **_segments(), **_density(),
        **_recommendations(), **_services(),
    }


def _reports() -> dict[str, str]:
    s: dict[str, str] = {}
    s["q1_monthly_revenue"] = f"""WITH {FACT}, {DIM_DATE},
m AS (SELECT year, month, month_name, sum(amount) AS revenue, count(DISTINCT customer_sk) AS active_customers
      FROM fact JOIN dim_date USING (date_sk) GROUP BY ALL),
g AS (SELECT *, lag(revenue) OVER (ORDER BY year, month) AS prev FROM m)
SELECT year, month, month_name, CAST(round(revenue, 0) AS DOUBLE) AS revenue, active_customers,
       {ratio(cents('(revenue - prev)') + ' * 100', cents('prev'), 2)} AS mom_growth_pct,
       {ratio(cents('revenue'), 'active_customers * 100', 2)} AS arpu
FROM g"""
    s["q2_value_tiers"] = f"""WITH {FACT}, {DIM_CUSTOMER},
cs AS (SELECT customer_id, city, contract_type, segment_name, sum(amount) AS spend, count(*) AS months_active
       FROM fact JOIN dim_customer USING (customer_sk) GROUP BY 1, 2, 3, 4),
w AS (SELECT *, ntile(4) OVER (ORDER BY spend DESC, customer_id) AS q,
             sum(spend) OVER (ORDER BY spend DESC, customer_id ROWS UNBOUNDED PRECEDING) AS running,
             sum(spend) OVER () AS total FROM cs)
SELECT customer_id, city, contract_type, segment_name, CAST(round(spend, 0) AS DOUBLE) AS total_spend,
       months_active, CAST(q AS INT) AS spend_quartile,
       {ratio(cents('running') + ' * 100', cents('total'), 2)} AS cumulative_pct
FROM w"""
    s["q3_top_customers_per_city"] = f"""WITH {FACT}, {DIM_CUSTOMER},
cs AS (SELECT customer_id, city, sum(amount) AS spend FROM fact JOIN dim_customer USING (customer_sk) GROUP BY 1, 2)
SELECT city, customer_id, CAST(round(spend, 0) AS DOUBLE) AS total_spend FROM cs
QUALIFY row_number() OVER (PARTITION BY city ORDER BY spend DESC, customer_id) <= 3"""
    s["q4_tariff_changes"] = f"""WITH {FACT}, {DIM_CUSTOMER}, {DIM_TARIFF}, {DIM_DATE},
h AS (SELECT customer_id, full_date, tariff_id, monthly_price,
             lag(monthly_price) OVER w AS prev_price, lag(tariff_id) OVER w AS prev_tariff
      FROM fact JOIN dim_customer USING (customer_sk) JOIN dim_tariff USING (tariff_sk) JOIN dim_date USING (date_sk)
      WINDOW w AS (PARTITION BY customer_id ORDER BY full_date, transaction_id))
SELECT customer_id, full_date AS change_date, prev_tariff AS from_tariff, tariff_id AS to_tariff,
       CAST(round(prev_price, 0) AS DOUBLE) AS from_price, CAST(round(monthly_price, 0) AS DOUBLE) AS to_price,
       CASE WHEN monthly_price > prev_price THEN 'upgrade' WHEN monthly_price < prev_price THEN 'downgrade'
            ELSE 'lateral' END AS change_type
FROM h WHERE prev_tariff IS NOT NULL AND prev_tariff <> tariff_id"""
    s["q5_cohort_retention"] = f"""WITH {FACT}, {DIM_CUSTOMER}, {DIM_DATE},
fm AS (SELECT customer_id, min(year * 100 + month) AS cohort_ym
       FROM fact JOIN dim_customer USING (customer_sk) JOIN dim_date USING (date_sk) GROUP BY 1),
a AS (SELECT customer_id, cohort_ym,
             (year * 12 + month) - (cohort_ym // 100 * 12 + cohort_ym % 100) AS period_num
      FROM fact JOIN dim_customer USING (customer_sk) JOIN dim_date USING (date_sk) JOIN fm USING (customer_id)),
cs AS (SELECT cohort_ym, count(DISTINCT customer_id) AS cohort_size FROM fm GROUP BY 1)
SELECT CAST(cohort_ym AS INT) AS cohort_ym, cohort_size, CAST(period_num AS INT) AS period_num,
       count(DISTINCT customer_id) AS retained,
       {ratio('count(DISTINCT customer_id) * 100', 'cohort_size', 1)} AS retention_pct
FROM a JOIN cs USING (cohort_ym) GROUP BY cohort_ym, cohort_size, period_num"""
    s["q6_churn_by_segment"] = _q6(_MONTHS, "count(*)", "count(*) FILTER (WHERE churn_flag)", "1")
    s["q6_churn_by_segment_literal"] = f"""WITH {FACT}, {DIM_CUSTOMER}, {DIM_DATE},
fc AS (SELECT customer_sk, min(full_date) AS first_date FROM fact JOIN dim_date USING (date_sk) GROUP BY 1),
s AS (SELECT c.segment_name, count(DISTINCT c.customer_id) AS n_customers,
             CAST(sum(CAST(c.churn_flag AS INT)) AS BIGINT) AS churned,
             {ratio(cents('sum(f.amount)'), '100 * count(*)', 2)} AS avg_monthly_spend,
             {ratio(f'sum({_MONTHS} % 12)', 'count(*)', 1)} AS avg_tenure_months
      FROM dim_customer c JOIN fact f ON c.customer_sk = f.customer_sk JOIN fc ON c.customer_sk = fc.customer_sk
      GROUP BY 1)
SELECT segment_name, n_customers, churned, {ratio('churned * 100', 'n_customers', 1)} AS churn_rate_pct,
       avg_monthly_spend, avg_tenure_months,
       CAST(rank() OVER (ORDER BY churned * 1.0 / NULLIF(n_customers, 0) DESC NULLS FIRST) AS INT) AS churn_risk_rank,
       {_RISK} AS risk_level
FROM s"""
    s["q7_days_to_next"] = f"""WITH {FACT}, {DIM_CUSTOMER}, {DIM_DATE},
o AS (SELECT customer_id, full_date AS tx_date, amount,
             lead(full_date) OVER (PARTITION BY customer_id ORDER BY full_date, transaction_id) AS next_tx_date
      FROM fact JOIN dim_customer USING (customer_sk) JOIN dim_date USING (date_sk))
SELECT customer_id, tx_date, CAST(round(amount, 0) AS DOUBLE) AS amount, next_tx_date,
       CAST(next_tx_date - tx_date AS INT) AS days_to_next
FROM o"""
    small = ", ".join(f"CAST({c} AS SMALLINT) AS {c}" for c in
                      ("year", "quarter", "month", "week_of_year", "day_of_month", "day_of_week"))
    s["dim_date"] = f"WITH {DIM_DATE} SELECT * REPLACE ({small}) FROM dim_date"
    return s


def _features() -> dict[str, str]:
    s: dict[str, str] = {}
    columns = "customer_id, recency, frequency, monetary, round(avg_data_gb, 6) AS avg_data_gb, round(avg_minutes, 6) AS avg_minutes"
    scores = "r_score, f_score, m_score, rfm_score"
    s["rfm_base"] = f"WITH {rfm()} SELECT {columns} FROM rfm"
    s["rfm_scores"] = f"WITH {rfm()} SELECT {columns}, {scores} FROM rfm"
    s["rfm_merged"] = f"""WITH {rfm()}, {SUBSCRIBERS}
SELECT s.customer_id, age, gender, city, tenure_months, tariff_id, contract_type, payment_method, paperless_billing,
       has_internet, has_tv, has_roaming, churn, segment_name,
       coalesce(recency, 999) AS recency, coalesce(frequency, 0) AS frequency, coalesce(monetary, 0) AS monetary,
       round(coalesce(avg_data_gb, 0), 6) AS avg_data_gb, round(coalesce(avg_minutes, 0), 6) AS avg_minutes,
       coalesce(r_score, 1) AS r_score, coalesce(f_score, 1) AS f_score, coalesce(m_score, 1) AS m_score,
       coalesce(rfm_score, 111) AS rfm_score
FROM subscribers s LEFT JOIN rfm USING (customer_id)"""
    s["rfm_score_counts"] = f"""WITH {rfm()}
SELECT 'r_score' AS score, r_score AS level, count(*) AS count FROM rfm GROUP BY 2
UNION ALL SELECT 'f_score', f_score, count(*) FROM rfm GROUP BY 2
UNION ALL SELECT 'm_score', m_score, count(*) FROM rfm GROUP BY 2"""
    return s


def _boards() -> dict[str, str]:
    s: dict[str, str] = {}
    s["kpi_monthly_revenue"] = f"""WITH {FACT}
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS revenue
FROM fact GROUP BY 1"""
    s["kpi_overview"] = f"""WITH {FACT}, {SUBSCRIBERS},
m AS (SELECT date_trunc('month', transaction_date) AS month, sum(amount) AS revenue FROM fact GROUP BY 1)
SELECT count(*) AS customers, round(avg(churn), 6) AS churn_rate,
       round((SELECT avg(revenue) FROM m), 2) AS avg_monthly_revenue,
       round((SELECT avg(revenue) FROM m) / count(*), 4) AS arpu
FROM subscribers"""
    for key, column in (("contract", "contract_type"), ("segment", "segment_name"), ("city", "city"),
                        ("payment", "payment_method")):
        s[f"churn_by_{key}"] = f"WITH {SUBSCRIBERS} SELECT {column}, round(avg(churn), 6) AS churn_rate FROM subscribers GROUP BY 1"
    s["customers_by_city"] = f"WITH {SUBSCRIBERS} SELECT city, count(*) AS count FROM subscribers GROUP BY 1"
    s["segment_counts"] = f"WITH {SUBSCRIBERS} SELECT segment_name, count(*) AS count FROM subscribers GROUP BY 1"
    s["distinct_segments"] = f"WITH {SUBSCRIBERS} SELECT DISTINCT segment_name FROM subscribers"
    s["segment_explorer"] = f"""WITH {SUBSCRIBERS}
SELECT customer_id, age, city, tenure_months, contract_type, churn FROM subscribers
WHERE segment_name = 'ASIA' ORDER BY customer_id LIMIT 50"""
    s["risk_level_scoring"] = f"""WITH {SCORED}
SELECT customer_id, churn_probability, CASE WHEN churn_probability >= 0.7 THEN 'high'
       WHEN churn_probability >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM scored"""
    s["risk_level_bins"] = f"WITH {SCORED} SELECT customer_id, churn_probability, {_BINS} AS risk_level FROM scored"
    s["risk_counts"] = f"""WITH {SCORED} SELECT {_BINS} AS risk_level, count(*) AS count FROM scored
WHERE {_BINS} IS NOT NULL GROUP BY 1"""
    s["churn_kpis"] = f"""WITH {SCORED}
SELECT count(*) FILTER (WHERE {_BINS} = 'High') AS high_risk, count(*) FILTER (WHERE {_BINS} = 'Medium') AS medium_risk,
       round(avg(churn_probability), 6) AS avg_probability, round(avg(churn), 6) AS actual_churn FROM scored"""
    s["high_risk_customers"] = f"""WITH {SCORED}
SELECT customer_id, churn_probability, {_BINS} AS risk_level, tenure_months, contract_type, city FROM scored
WHERE churn_probability >= 0.6 ORDER BY churn_probability DESC, customer_id LIMIT 100"""
    s["segment_profile_dash"] = f"""WITH {ENRICHED}
SELECT segment_name, round_even(avg(monetary), 1) AS avg_monetary, round_even(avg(recency), 1) AS avg_recency,
       round_even(avg(frequency), 1) AS avg_frequency, round_even(avg(tenure_months), 1) AS avg_tenure, count(*) AS count
FROM enriched GROUP BY 1"""
    width = "((hi - lo) / 30.0)"
    s["histogram_by_class"] = f"""WITH {ENRICHED},
l AS (SELECT churn, CAST(min(tenure_months) AS DOUBLE) AS lo, CAST(max(tenure_months) AS DOUBLE) AS hi FROM enriched GROUP BY 1),
b AS (SELECT churn, CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((tenure_months - lo) / {width}) AS INT) + 1, 30) END AS bin
      FROM enriched JOIN l USING (churn))
SELECT churn, bin, count(*) AS n FROM b GROUP BY ALL"""
    s["histogram_by_risk"] = f"""WITH {SCORED}, v AS (SELECT {_BINS} AS risk_level, churn_probability AS p FROM scored),
l AS (SELECT risk_level, min(p) AS lo, max(p) AS hi FROM v WHERE risk_level IS NOT NULL GROUP BY 1),
b AS (SELECT risk_level, CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((p - lo) / ((hi - lo) / 40.0::DOUBLE)) AS INT) + 1, 40) END AS bin
      FROM v JOIN l USING (risk_level))
SELECT risk_level, bin, count(*) AS n FROM b GROUP BY ALL"""
    s["box_monetary_by_churn"] = f"""WITH {ENRICHED},
f AS (SELECT churn, quantile_cont(monetary, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM enriched GROUP BY 1),
g AS (SELECT churn, q[1] AS mn, q[2] AS q1, q[3] AS md, q[4] AS q3, q[5] AS mx FROM f),
e AS (SELECT g.*, monetary, monetary BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
      FROM enriched JOIN g USING (churn))
SELECT churn, round(mn, 4) AS min, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3, round(mx, 4) AS max,
       round(min(monetary) FILTER (WHERE inside), 4) AS whisker_low,
       round(max(monetary) FILTER (WHERE inside), 4) AS whisker_high,
       count(*) FILTER (WHERE NOT inside) AS outliers
FROM e GROUP BY churn, mn, q1, md, q3, mx"""
    described = ["age", "tenure_months", "paperless_billing", "has_internet", "has_tv", "has_roaming", "churn",
                 "recency", "frequency", "monetary", "avg_data_gb", "avg_minutes", "r_score", "f_score", "m_score",
                 "rfm_score"]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM enriched" for c in described)
    s["describe_numeric"] = f"""WITH {ENRICHED}, l AS ({parts})
SELECT feature, count(*) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min,
       round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50,
       round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS max
FROM l GROUP BY 1"""
    names = ["age", "tenure_months", "has_internet", "has_tv", "has_roaming", "recency", "frequency", "monetary", "churn"]
    s["corr_matrix"] = f"WITH {ENRICHED} " + " UNION ALL ".join(
        f"SELECT '{names[i]}' AS feature_a, '{names[j]}' AS feature_b, round(corr({names[i]}, {names[j]}), 6) AS correlation FROM enriched"
        for i in range(len(names)) for j in range(i))
    s["eda_summary"] = f"""WITH {ENRICHED}
SELECT count(*) AS customers, round(avg(churn), 6) AS churn_rate, round(avg(tenure_months), 6) AS avg_tenure,
       round(avg(monetary) / 12, 4) AS avg_monthly_spend,
       round(avg(CASE WHEN contract_type = 'BUILDING' THEN 1 ELSE 0 END), 6) AS monthly_share,
       (SELECT count(*) FROM tx) AS transactions
FROM enriched"""
    return s


def _statistics() -> dict[str, str]:
    s: dict[str, str] = {}
    s["psi"] = f"WITH {drift(1.3)} SELECT feature, round(psi, 6) AS psi FROM psi"
    s["ks_statistic"] = f"""WITH {drift(1.3)}
SELECT feature, round(d, 9) AS ks_statistic, CAST(nr AS BIGINT) AS n_r, CAST(nc AS BIGINT) AS n_c, round(p, 6) AS ks_pvalue FROM ksp"""
    report = """SELECT feature, round_even(psi, 4) AS psi, round_even(d, 4) AS ks_statistic, round_even(p, 4) AS ks_pvalue,
       (psi > 0.2 OR p < 0.05) AS drift_detected,
       CASE WHEN psi > 0.25 THEN 'high' WHEN psi > 0.1 THEN 'medium' ELSE 'low' END AS severity
FROM psi JOIN ksp USING (feature)"""
    s["drift_report"] = f"WITH {drift(1.3)} {report}"
    s["drift_report_stable"] = f"WITH {drift(1)} {report}"
    s["ab_frame"] = f"""WITH {EXPERIMENT}
SELECT customer_id, "group", converted, round(arpu_before, 6) AS arpu_before, round(arpu_after, 6) AS arpu_after,
       round(arpu_delta, 6) AS arpu_delta FROM ab"""
    s["ab_group_means"] = f"""WITH {EXPERIMENT}
SELECT "group", round_even(avg(converted), 2) AS converted, round_even(avg(arpu_before), 2) AS arpu_before,
       round_even(avg(arpu_after), 2) AS arpu_after, round_even(avg(arpu_delta), 2) AS arpu_delta FROM ab GROUP BY 1"""
    s["ab_sample_size"] = f"""WITH {SUBSCRIBERS},
b AS (SELECT contract_type, avg(churn) AS p FROM subscribers GROUP BY 1),
m AS (SELECT *, p + 0.04 AS p2, (p + p + 0.04) / 2 AS pm FROM b)
SELECT contract_type, round(p, 6) AS baseline, CAST(ceil(power(1.959963984540054 * sqrt(2 * pm * (1 - pm))
       + 0.8416212335729143 * sqrt(p * (1 - p) + p2 * (1 - p2)), 2) / (0.04 * 0.04)) AS BIGINT) AS required
FROM m"""

    def conversion(by: str) -> str:
        key = f"{by}, " if by else ""
        group = f"GROUP BY {by}" if by else ""
        return f"""
cnt AS (SELECT {key}CAST(count(*) FILTER (WHERE "group" = 'control') AS DOUBLE) AS nc,
               CAST(count(*) FILTER (WHERE "group" = 'treatment') AS DOUBLE) AS nt,
               CAST(sum(converted) FILTER (WHERE "group" = 'control') AS DOUBLE) AS sc,
               CAST(sum(converted) FILTER (WHERE "group" = 'treatment') AS DOUBLE) AS st FROM ab {group}),
r AS (SELECT *, sc / nc AS pc, st / nt AS pt, (sc + st) / (nc + nt) AS pp FROM cnt),
z AS (SELECT *, (pt - pc) / sqrt(pp * (1 - pp) * (1 / nc + 1 / nt)) AS z,
             1.96 * sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt) AS margin FROM r),
t AS (SELECT *, {normal_p('z')} AS p FROM z)"""

    s["ab_conversion_test"] = f"""WITH {EXPERIMENT}, {conversion('')}
SELECT round_even(pc, 4) AS p_control, round_even(pt, 4) AS p_treatment, round_even(pt - pc, 4) AS abs_diff,
       round_even((pt - pc) / pc, 4) AS relative_lift, round_even(z, 4) AS z_statistic, round_even(p, 6) AS p_value,
       round_even(pt - pc - margin, 4) AS ci_low, round_even(pt - pc + margin, 4) AS ci_high, p < 0.05 AS significant
FROM t"""
    by_segment = EXPERIMENT.replace("FROM customer LEFT JOIN spend", "FROM customer JOIN nation ON c_nationkey = n_nationkey "
                                    "JOIN region ON n_regionkey = r_regionkey LEFT JOIN spend").replace(
        "SELECT c_custkey AS customer_id,", "SELECT c_custkey AS customer_id, r_name AS segment_name,")
    s["bonferroni"] = f"""WITH {by_segment}, {conversion('segment_name')}
SELECT segment_name, round_even(p, 6) AS p_value, round_even(p, 6) < 0.05 / count(*) OVER () AS reject FROM t"""
    s["ab_conversion_ci"] = f"""WITH {EXPERIMENT}
SELECT "group", count(*) AS n, round(avg(converted) * 100, 6) AS rate_pct,
       round(196 * sqrt(avg(converted) * (1 - avg(converted)) / count(*)), 6) AS error_pct FROM ab GROUP BY 1"""
    s["ab_arpu_test"] = f"""WITH {EXPERIMENT},
m AS (SELECT avg(arpu_delta) FILTER (WHERE "group" = 'control') AS mc, avg(arpu_delta) FILTER (WHERE "group" = 'treatment') AS mt,
             var_samp(arpu_delta) FILTER (WHERE "group" = 'control') AS vc,
             var_samp(arpu_delta) FILTER (WHERE "group" = 'treatment') AS vt,
             CAST(count(*) FILTER (WHERE "group" = 'control') AS DOUBLE) AS nc,
             CAST(count(*) FILTER (WHERE "group" = 'treatment') AS DOUBLE) AS nt FROM ab),
rk AS (SELECT "group", rank() OVER (ORDER BY arpu_delta) + (count(*) OVER (PARTITION BY arpu_delta) - 1) / 2.0 AS r FROM ab),
ties AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT count(*) AS t FROM ab GROUP BY arpu_delta)),
u AS (SELECT sum(r) AS rs FROM rk WHERE "group" = 'control'),
x AS (SELECT *, rs - nc * (nc + 1) / 2 AS u1, (mc - mt) / sqrt(vc / nc + vt / nt) AS t,
             power(vc / nc + vt / nt, 2) / (power(vc / nc, 2) / (nc - 1) + power(vt / nt, 2) / (nt - 1)) AS dof,
             (mt - mc) / sqrt((vc + vt) / 2) AS d,
             sqrt(nc * nt / 12 * (nc + nt + 1 - ties / ((nc + nt) * (nc + nt - 1)))) AS sd
      FROM m, u, ties),
y AS (SELECT *, greatest((greatest(u1, nc * nt - u1) - nc * nt / 2 - 0.5) / sd, 0.0) AS z FROM x),
q AS (SELECT *, {student_p('t', 'dof')} AS tp, {normal_p('z')} AS mp FROM y)
SELECT round_even(mc, 2) AS control_mean_delta, round_even(mt, 2) AS treatment_mean_delta, round_even(t, 4) AS t_statistic,
       round_even(tp, 6) AS t_pvalue, u1 AS mw_statistic, round_even(mp, 6) AS mw_pvalue, round_even(d, 4) AS cohens_d,
       tp < 0.05 AS significant_ttest, mp < 0.05 AS significant_mw
FROM q"""
    return s


def _generated() -> str:
    """CTE of the generated customers for the rows of the customer table."""
    def u(i: int) -> str:
        return word("id", 42, f"customer{i // 4}", i % 4)

    tariff = "CASE " + " ".join(
        f"{'WHEN age < ' + str(limit) + ' THEN' if limit else 'ELSE'} {pick('u_tariff', ids, weights)}"
        for limit, ids, weights in generate.TARIFFS_BY_AGE) + " END"
    flags = ", ".join(f"CAST({u(7 + i)} >= {1 - share!r}::DOUBLE AS INT) AS {flag}"
                      for i, (flag, share) in enumerate(generate.FLAGS.items()))
    return f"""
ids AS (SELECT c_custkey + 1 AS id FROM customer),
drawn AS (
  SELECT printf('C%06d', id) AS customer_id, CAST(18 + floor({u(0)} * 57) AS INT) AS age,
         {pick(u(1), *generate.GENDERS)} AS gender, {pick(u(2), *generate.CITIES)} AS city,
         CAST(1 + floor({u(3)} * 83) AS INT) AS tenure_months, {u(4)} AS u_tariff,
         {pick(u(5), *generate.CONTRACTS)} AS contract_type, {pick(u(6), *generate.PAYMENTS)} AS payment_method,
         {flags}, {u(11)} AS u_churn
  FROM ids),
made AS (
  SELECT customer_id, age, gender, city, tenure_months, {tariff} AS tariff_id, contract_type, payment_method,
         paperless_billing, has_internet, has_tv, has_roaming,
         CAST(u_churn < least(greatest(0.1::DOUBLE + CASE WHEN contract_type = 'monthly' THEN 0.18::DOUBLE ELSE 0 END
           + CASE WHEN tenure_months < 12 THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN tenure_months > 48 THEN 0.08::DOUBLE ELSE 0 END
           + CASE WHEN payment_method = 'cash' THEN 0.05::DOUBLE ELSE 0 END - has_tv * 0.04::DOUBLE - has_internet * 0.03::DOUBLE,
           0.01::DOUBLE), 0.85::DOUBLE) AS INT) AS churn
  FROM drawn)"""


def _sources() -> dict[str, str]:
    s: dict[str, str] = {}
    s["scan_csv"] = f"""WITH {RAW}
SELECT customer_id, age, gender, city, tenure_months, tariff_id, contract_type, payment_method, paperless_billing,
       has_internet, has_tv, has_roaming, churn FROM raw_customers"""
    s["sink_roundtrip"] = f"""WITH {RAW}
SELECT transaction_id, customer_id, transaction_date, amount, CAST(data_gb_used AS DECIMAL(8,2)) AS data_gb_used,
       CAST(minutes_used AS DECIMAL(10,1)) AS minutes_used, tariff_id FROM raw_transactions"""
    s["scan_tariffs"] = """
SELECT p_brand AS tariff_id, 'Plan ' || regexp_extract(p_brand, '([0-9]+)$', 1) AS name,
       CAST(round(CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) / count(*), 2) AS DECIMAL(10,2)) AS monthly_price,
       CAST(floor(round(CAST(sum(p_size) AS DOUBLE) / count(*), 2)) AS INT) AS data_gb, CAST(count(*) AS INT) AS minutes,
       'G' || (CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 5) AS category
FROM part GROUP BY p_brand"""
    missing = {"recency": (13, "c_custkey % 300"), "frequency": (17, "c_custkey % 40"), "monetary": (19, "c_acctbal"), "tenure_months": (23, "c_custkey % 84")}
    fields = ", ".join(f"CASE WHEN c_custkey % {m} <> 0 THEN CAST({v} AS DOUBLE) END AS {c}" for c, (m, v) in missing.items())
    lacks = ", ".join(f"CASE WHEN c_custkey % {m} = 0 THEN '{c}:missing' END" for c, (m, _) in missing.items())
    s["validate_segments"] = f"""
SELECT c_custkey AS request_id, {fields}, CAST(c_custkey % 50 AS DOUBLE) AS avg_data_gb, concat_ws(',', {lacks}) AS violations FROM customer"""
    s["telco_normalise"] = """
SELECT c_name AS customerid, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS seniorcitizen,
       c_acctbal AS monthly_charges,
       CASE WHEN c_custkey % 10 = 0 THEN (SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_custkey % 10 <> 0)
            ELSE c_acctbal END AS totalcharges,
       CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS churn
FROM customer"""
    s["gen_customers"] = f"WITH {_generated()} SELECT * FROM made"

    def scaled(column: str, part: int, low: float, high: float, digits: int) -> str:
        u = word("(customer_id || '-' || step)", 43, "transaction", part)
        return f"round({column} * ({low}::DOUBLE + {u} * {high - low!r}::DOUBLE), {digits})"

    plans = ", ".join(f"('{t[0]}', {t[2]}, {t[3]}, {t[4]})" for t in generate.TARIFFS)
    s["gen_transactions"] = f"""WITH {_generated()},
plans(tariff_id, price, gb, mins) AS (VALUES {plans}),
steps AS (SELECT *, unnest(range(0, least(12, tenure_months))) AS step FROM made JOIN plans USING (tariff_id))
SELECT 'TX' || substr(customer_id, 2) || printf('%03d', step) AS transaction_id, customer_id,
       DATE '2025-12-01' - CAST(30 * step AS INT) AS transaction_date,
       {scaled('price', 0, 0.9, 1.4, 2)} AS amount, {scaled('gb', 1, 0.4, 1.2, 2)} AS data_gb_used,
       {scaled('mins', 2, 0.3, 1.1, 1)} AS minutes_used, tariff_id
FROM steps"""
    s["gen_summary"] = f"""WITH {_generated()}
SELECT 'customers' AS "table", count(*) AS rows FROM made
UNION ALL SELECT 'transactions', CAST(sum(least(12, tenure_months)) AS BIGINT) FROM made
UNION ALL SELECT 'tariffs', {len(generate.TARIFFS)}"""
    def u(stream: str) -> str:
        return word("(\"group\" || '-' || id)", 42, stream)

    s["gen_ab"] = f"""WITH r AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS "group" FROM customer),
x AS (SELECT id, "group", CAST({u('convert')} < CASE WHEN "group" = 'treatment' THEN 0.13::DOUBLE ELSE 0.08::DOUBLE END AS INT) AS converted,
             4500 + 1200 * (sqrt(-2 * ln(1 - {u('radius')})) * cos(2 * pi() * {u('angle')})) AS b,
             0.12 + {u('uplift')} * 0.13 AS up, {u('noise')} AS noise FROM r),
y AS (SELECT *, b * CASE WHEN "group" = 'treatment' THEN (1 + converted * up) * (0.99 + noise * 0.07)
                         ELSE 0.98 + noise * 0.07 END AS a FROM x)
SELECT id, "group", converted, round(b, 5) AS arpu_before, round(a, 5) AS arpu_after, round(a - b, 5) AS arpu_delta FROM y"""
    s["star_dim_customer"] = f"""WITH {STAR}
SELECT * REPLACE (CAST(age AS SMALLINT) AS age, CAST(segment AS SMALLINT) AS segment) FROM star_customer"""
    s["star_dim_city"] = f"WITH {STAR} SELECT * FROM star_city"
    s["star_fact"] = f"WITH {STAR} SELECT * FROM star_fact"
    loads = ", ".join(f"(DATE '{day}')" for day in LOADS)
    versions = f"""loads(day) AS (VALUES {loads}),
state AS (
  SELECT day, c_name AS customer_id, any_value(n_name) AS city, any_value(c_mktsegment) AS contract_type,
         'T0' || substr(arg_max(o_orderpriority, (o_orderdate, o_orderkey)), 1, 1) AS tariff_id,
         max(o_orderdate) >= day::TIMESTAMP - INTERVAL 365 DAY AS active
  FROM loads JOIN orders ON o_orderdate < day::TIMESTAMP JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  GROUP BY day, c_name),
changed AS (
  SELECT * FROM state
  QUALIFY (city, contract_type, tariff_id, active) IS DISTINCT FROM lag((city, contract_type, tariff_id, active)) OVER (PARTITION BY customer_id ORDER BY day)),
versions AS (
  SELECT row_number() OVER (ORDER BY day, customer_id) AS customer_sk, customer_id, city, contract_type, tariff_id, active,
         day AS valid_from, lead(day) OVER (PARTITION BY customer_id ORDER BY day) AS valid_to FROM changed)"""
    s["star_customer_history"] = f"WITH {versions} SELECT * FROM versions"
    s["star_customer_as_of"] = f"""WITH {versions}
SELECT * FROM versions WHERE valid_from <= DATE '1999-05-17' AND (valid_to IS NULL OR valid_to > DATE '1999-05-17')"""
    s["star_fact_history"] = f"""WITH {versions}
SELECT c_name AS customer_id, customer_sk, count(*) AS transactions, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS spend
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN versions v ON v.customer_id = c_name AND CAST(o_orderdate AS DATE) >= valid_from AND (valid_to IS NULL OR CAST(o_orderdate AS DATE) < valid_to)
GROUP BY ALL"""
    s["star_intake"] = f"""WITH {STAR}, told AS (
  SELECT concat_ws(',', CASE WHEN c.customer_id IS NULL THEN 'customer' END, CASE WHEN t.tariff_id IS NULL THEN 'tariff' END,
                   CASE WHEN transaction_date IS NULL THEN 'date' END) AS reasons
  FROM raw_transactions f LEFT JOIN star_customer c USING (customer_id) LEFT JOIN star_tariff t USING (tariff_id))
SELECT CASE WHEN reasons = '' THEN 'stored' ELSE reasons END AS outcome, count(*) AS transactions FROM told GROUP BY 1"""

    stored = {"dim_customer": "star_customer", "dim_tariff": "star_tariff", "dim_date": "dim_date",
              "dim_city": "star_city", "fact_transactions": "star_fact"}
    parts = []
    for rule in star_constraints() + RAW_RULES:
        table, column = stored.get(rule.table, rule.table), rule.columns[0]
        if rule.kind == "not_null":
            count = f"(SELECT count(*) FROM {table} WHERE {column} IS NULL)"
        elif rule.kind == "length":
            count = f"(SELECT count(*) FROM {table} WHERE length({column}) > {rule.limit})"
        elif rule.kind == "unique":
            keys = ", ".join(rule.columns)
            count = f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table})) FROM {table})"
        else:
            parent, key = rule.target
            count = (f"(SELECT count(*) FROM {table} x WHERE {column} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {stored.get(parent, parent)} p WHERE p.{key} = x.{column}))")
        parts.append(f"SELECT '{rule.name}' AS \"constraint\", {count} AS violations")
    s["constraint_report"] = f"WITH {STAR}, {DIM_DATE}\n" + " UNION ALL\n".join(parts)

    req = """
r AS (SELECT c_custkey AS request_id, c_custkey % 120 AS age, c_custkey % 11 = 0 AS no_gender, c_custkey % 90 - 2 AS tenure,
             c_custkey % 3 AS paperless, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 2 END AS internet,
             CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 365 AS DOUBLE) END AS recency,
             CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal + 1000 END AS monetary FROM customer)"""
    s["validate_features"] = f"""WITH {req}
SELECT request_id, coalesce(recency, 30.0) AS recency, 6.0::DOUBLE AS frequency, coalesce(monetary, 5000.0) AS monetary,
       15.0::DOUBLE AS avg_data_gb, 300.0::DOUBLE AS avg_minutes,
       concat_ws(',', CASE WHEN internet IS NULL THEN 'has_internet:missing' END, CASE WHEN no_gender THEN 'gender:missing' END,
                 CASE WHEN age < 18 OR age > 100 THEN 'age:range' END, CASE WHEN tenure < 0 THEN 'tenure_months:range' END,
                 CASE WHEN paperless > 1 THEN 'paperless_billing:range' END) AS violations
FROM r"""
    board = "SELECT count(*) FILTER (WHERE {b} = 'High') AS h, count(*) FILTER (WHERE {b} = 'Medium') AS m, " \
            "avg(churn_probability) AS p, avg(churn) AS c FROM scored".format(b=_BINS)
    s["run_metrics"] = f"""WITH {SCORED}, b AS ({board})
SELECT 'board' AS run_name, 'metric' AS kind, 'high_risk' AS key, CAST(h AS DOUBLE) AS number, NULL AS text FROM b
UNION ALL SELECT 'board', 'metric', 'medium_risk', CAST(m AS DOUBLE), NULL FROM b
UNION ALL SELECT 'board', 'metric', 'avg_probability', round(p, 9), NULL FROM b
UNION ALL SELECT 'board', 'metric', 'actual_churn', round(c, 9), NULL FROM b
UNION ALL SELECT 'board', 'param', 'threshold', NULL, '0.5'"""
    return s


def _segments() -> dict[str, str]:
    s: dict[str, str] = {}
    s["split_features"] = f"""WITH {SUBSCRIBERS}
SELECT customer_id, churn, age, gender, city, tenure_months, tariff_id, contract_type, payment_method, paperless_billing,
       has_internet, has_tv, has_roaming FROM subscribers"""
    scaled = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
                       for c in ("age", "tenure_months", "recency", "frequency", "monetary"))
    s["standard_scale"] = f"WITH {ENRICHED} SELECT customer_id, {scaled} FROM enriched"
    s["one_hot"] = f"WITH {SUBSCRIBERS} SELECT customer_id, " + ", ".join(
        f"CAST({c} = '{v}' AS INT) AS {c}_{v}" for c, vs in
        (("contract_type", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), ("gender", ("F", "M"))) for v in vs
    ) + " FROM subscribers"
    numeric = ["age", "tenure_months", "paperless_billing", "has_internet", "has_tv", "has_roaming",
               "recency", "frequency", "monetary", "avg_data_gb", "avg_minutes"]
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in numeric)
    s["feature_matrix"] = f"""WITH {ENRICHED}, z AS (SELECT customer_id, [{z}] AS z FROM enriched),
w AS (SELECT count(DISTINCT gender) + count(DISTINCT city) + count(DISTINCT contract_type)
             + count(DISTINCT payment_method) + count(DISTINCT tariff_id) AS n FROM enriched)
SELECT customer_id, CAST({len(numeric)} + n AS INT) AS n_features, round(list_sum(z) + 5, 6) AS total,
       CAST(5 + len(list_filter(z, lambda v: v = 1.0)) AS INT) AS n_ones FROM z, w"""
    s["sample_rfm"] = f"""WITH {ENRICHED}
SELECT customer_id, recency, monetary, segment_name FROM enriched ORDER BY md5(customer_id || ':42:sample'), customer_id LIMIT 1000"""
    s["stratified_split"] = f"""WITH {SUBSCRIBERS}
SELECT customer_id, churn, row_number() OVER (PARTITION BY churn ORDER BY md5(customer_id || ':42:split'))
       <= round_even(count(*) OVER (PARTITION BY churn) * 0.2, 0) AS is_test FROM subscribers"""
    feats = ["recency", "frequency", "monetary", "tenure_months", "avg_data_gb"]
    s["segment_profile"] = f"""WITH {ENRICHED}
SELECT CAST(customer_id % 5 AS INT) AS segment, """ + ", ".join(
        f"round(avg({c}), 4) AS {c}_mean, count({c}) AS {c}_count" for c in feats) + " FROM enriched GROUP BY 1"
    names = "['Champions', 'Loyal', 'Potential', 'At Risk', 'Hibernating']"
    named = f"""
p AS (SELECT CAST(customer_id % 5 AS INT) AS segment, avg(monetary) AS m FROM enriched GROUP BY 1),
nm AS (SELECT segment, {names}[row_number() OVER (ORDER BY m DESC, segment)] AS segment_name FROM p)"""
    s["segment_names"] = f"WITH {ENRICHED}, {named} SELECT segment, segment_name FROM nm"
    s["segment_named"] = f"""WITH {ENRICHED}, {named}
SELECT customer_id, segment, nm.segment_name FROM enriched JOIN nm ON CAST(customer_id % 5 AS INT) = segment"""
    s["silhouette"] = """WITH s AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY md5(vec_id || ':42:sample'), vec_id LIMIT 5000),
n AS (SELECT label, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM s a, s b GROUP BY ALL),
e AS (SELECT vec_id, own, min(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS inner_d,
             min(CASE WHEN own <> other THEN total / n END) AS outer_d FROM d JOIN n ON other = n.label GROUP BY ALL)
SELECT round(avg(CASE WHEN inner_d IS NULL THEN 0 ELSE (outer_d - inner_d) / greatest(inner_d, outer_d) END), 6) AS silhouette,
       count(*) AS sampled FROM e"""
    # mean squared distance to a cluster = squared distance to its mean + its mean squared spread
    s["silhouette_all"] = """WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s),
c AS (SELECT label, i, avg(x) AS m, var_pop(x) AS spread, count(*) AS n FROM x GROUP BY ALL),
d AS (SELECT vec_id, x.label AS own, c.label AS other, sum((x.x - c.m) * (x.x - c.m) + c.spread) AS gap, max(c.n) AS n
      FROM x JOIN c ON x.i = c.i GROUP BY ALL),
e AS (SELECT vec_id, min(CASE WHEN own = other THEN gap * n / nullif(n - 1, 0) END) AS inner_d,
             min(CASE WHEN own <> other THEN gap END) AS outer_d FROM d GROUP BY ALL)
SELECT round(avg(CASE WHEN inner_d IS NULL THEN 0 ELSE (outer_d - inner_d) / greatest(inner_d, outer_d) END), 6) AS silhouette,
       count(*) AS scored FROM e"""
    return s


def _density() -> dict[str, str]:
    """DBSCAN by its definition: all pairs, core points, labels spread along core pairs."""
    feats = ["recency", "frequency", "monetary", "tenure_months", "avg_data_gb"]
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(feats))
    distance = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(5))
    labels = f"""WITH RECURSIVE {ENRICHED}, z AS (SELECT customer_id, {z} FROM enriched),
near AS MATERIALIZED (SELECT a.customer_id AS a, b.customer_id AS b FROM z a JOIN z b ON {distance} <= 0.8 * 0.8),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 30),
link AS MATERIALIZED (SELECT a, b FROM near JOIN core x ON a = x.id JOIN core y ON b = y.id),
spread(id, low) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION SELECT link.a, min(s.low) FROM spread s JOIN link ON s.id = link.b
        JOIN recurring.spread AS own ON own.id = link.a WHERE s.low < own.low GROUP BY link.a),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY low) - 1 AS label FROM spread),
border AS (SELECT a AS id, min(label) AS label FROM near JOIN numbered ON b = id
           WHERE a NOT IN (SELECT id FROM core) GROUP BY a),
labels AS (
  SELECT z.customer_id, CAST(coalesce(n.label, b.label, -1) AS BIGINT) AS label, n.id IS NOT NULL AS is_core
  FROM z LEFT JOIN numbered n ON z.customer_id = n.id LEFT JOIN border b ON z.customer_id = b.id)"""
    return {
        "dbscan": f"{labels} SELECT * FROM labels",
        "dbscan_summary": f"""{labels} SELECT count(DISTINCT label) FILTER (WHERE label >= 0) AS n_clusters,
       count(*) FILTER (WHERE label = -1) AS n_noise FROM labels""",
    }


def _recommendations() -> dict[str, str]:
    s: dict[str, str] = {}
    s["ratings"] = f"""WITH {PURCHASES},
x AS (SELECT *, min(spend) OVER w AS lo, max(spend) OVER w AS hi FROM rated WINDOW w AS (PARTITION BY customer_id))
SELECT customer_id, tariff_id, round(1 + 4 * CASE WHEN hi > lo THEN (spend - lo) / (hi - lo) ELSE 0 END, 6) AS rating, months FROM x"""
    s["tariff_popularity"] = f"WITH {PURCHASES} SELECT * FROM popularity"
    listed = "listed AS (SELECT c.*, coalesce(popularity, 0) AS popularity FROM catalog c LEFT JOIN popularity USING (tariff_id))"
    s["tariff_catalog_popularity"] = f"WITH {CATALOG}, {PURCHASES}, {listed} SELECT * FROM listed"
    s["current_tariff"] = f"WITH {PURCHASES} SELECT * FROM current"
    s["tariff_features"] = f"""WITH {COSINE}
SELECT tariff_id, round(v[1], 6) AS num__monthly_price, round(v[2], 6) AS num__data_gb, round(v[3], 6) AS num__minutes, """ + ", ".join(
        f"v[{4 + i}] AS cat__category_G{i}" for i in range(5)) + " FROM vec"
    s["tariff_cosine"] = f"WITH {COSINE} SELECT anchor, tariff_id, round(score, 6) AS score FROM cosine"
    place = "CAST(row_number() OVER (PARTITION BY anchor ORDER BY score DESC, tariff_id) AS INT)"
    s["rec_similar"] = f"""WITH {COSINE}, r AS (SELECT *, {place} AS rank FROM cosine WHERE anchor <> tariff_id)
SELECT anchor, rank, tariff_id, round(score, 6) AS score FROM r WHERE rank <= 5"""
    cold = "SELECT tariff_id, CAST(popularity AS DOUBLE) AS score FROM listed {} ORDER BY popularity DESC, tariff_id LIMIT {}"
    s["rec_cold_start"] = f"WITH {CATALOG}, {PURCHASES}, {listed} " + cold.format("", 5)
    s["rec_cold_start_category"] = f"WITH {CATALOG}, {PURCHASES}, {listed} " + cold.format("WHERE category = 'G2'", 3)
    s["rec_hybrid_coldstart"] = f"""WITH {COSINE}, {PURCHASES}, {listed},
pop AS (SELECT tariff_id, CASE WHEN max(popularity) OVER () > min(popularity) OVER ()
               THEN (popularity - min(popularity) OVER ()) / (max(popularity) OVER () - min(popularity) OVER ()) ELSE 0.5 END AS c
        FROM listed),
con AS (SELECT anchor, tariff_id, CASE WHEN max(score) OVER w > min(score) OVER w
               THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS b
        FROM cosine WHERE anchor <> tariff_id WINDOW w AS (PARTITION BY anchor)),
blend AS (SELECT customer_id, con.tariff_id, round(0.6 * c + 0.4 * b, 9) AS score
          FROM current JOIN con ON current_tariff = anchor JOIN pop ON pop.tariff_id = con.tariff_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, tariff_id) AS INT) AS rank FROM blend)
SELECT customer_id, rank, tariff_id, round(score, 6) AS score FROM r WHERE rank <= 5"""
    routes = """asked AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS customer_id,
         CASE WHEN c_custkey % 11 = 0 THEN 'Brand#99' WHEN c_custkey % 3 <> 0 THEN 'Brand#' || (c_custkey % 25 + 1) END AS wanted,
         CASE WHEN c_custkey % 2 = 0 THEN 'G' || c_custkey % 5 END AS category, c_custkey % 10 + 1 AS n,
         ['cold_start', 'similar', 'hybrid', 'collaborative', 'other'][c_custkey % 5 + 1] AS mode FROM customer),
routed AS (SELECT *, CASE WHEN mode = 'similar' AND wanted IS NOT NULL THEN 'similar'
       WHEN mode IN ('hybrid', 'collaborative') AND customer_id IS NOT NULL THEN mode ELSE 'cold_start' END AS route FROM asked)"""
    s["recommend_routes"] = f"WITH {routes} SELECT request_id, mode, route FROM routed"
    hybrid = s["rec_hybrid_coldstart"]
    hybrid = hybrid[: hybrid.rindex("SELECT customer_id, rank")]
    owned = "owned AS (SELECT customer_id, count(*) AS seen FROM rated GROUP BY 1), total AS (SELECT count(*) AS n FROM catalog)"
    rules = "{0} AS plans, {0} AS different, {0}::INTEGER AS last_rank, true AS falling, 0::BIGINT AS barred FROM owned, total"
    s["rec_collaborative_check"] = (
        f"WITH {CATALOG}, {PURCHASES}, {owned} SELECT customer_id, "
        + rules.format("least(5, CASE WHEN seen >= 3 THEN n - seen ELSE n END)")
        + " WHERE seen < 3 OR seen < n"
    )
    s["rec_hybrid_check"] = f"WITH {CATALOG}, {PURCHASES}, {owned} SELECT customer_id, " + rules.format("least(5, n - 1)")
    s["score_recommend_popular"] = f"""{hybrid}, {routes},
sim AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, tariff_id) AS rank FROM cosine WHERE anchor <> tariff_id),
cold AS (SELECT tariff_id, popularity AS score, category AS list, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, tariff_id) AS rank FROM listed
         UNION ALL SELECT tariff_id, popularity, '', row_number() OVER (ORDER BY popularity DESC, tariff_id) FROM listed),
answers AS (
  SELECT request_id, mode, route, n, r.rank, r.tariff_id, r.score FROM routed LEFT JOIN r USING (customer_id) WHERE route = 'hybrid'
  UNION ALL SELECT request_id, mode, route, n, rank, tariff_id, score FROM routed JOIN cold ON list = '' WHERE route = 'collaborative'
  UNION ALL SELECT request_id, mode, route, n, rank, tariff_id, score FROM routed LEFT JOIN sim ON wanted = anchor WHERE route = 'similar'
  UNION ALL SELECT request_id, mode, route, n, rank, tariff_id, score FROM routed JOIN cold ON list = coalesce(category, '') WHERE route = 'cold_start')
SELECT request_id, mode, route, CAST(rank AS INT) AS rank, tariff_id, coalesce(name, tariff_id) AS name,
       CAST(coalesce(floor(monthly_price), 0) AS INT) AS monthly_price, CAST(coalesce(floor(c.data_gb), 0) AS INT) AS data_gb,
       coalesce(c.category, '') AS category, round_even(score, 4) AS score,
       CASE WHEN route = 'similar' AND tariff_id IS NULL THEN '500' ELSE '200' END AS status
FROM answers LEFT JOIN catalog c USING (tariff_id) WHERE rank IS NULL OR rank <= n"""
    s["stream_recommend"] = s["score_recommend_popular"]
    s["rec_saved"] = s["rec_hybrid_coldstart"]
    return s


def _services() -> dict[str, str]:
    s: dict[str, str] = {}
    log = """log AS (SELECT ts, event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
       value / 1000.0::DOUBLE AS seconds FROM events)"""
    s["request_counts"] = f"WITH {log} SELECT endpoint, status, count(*) AS requests FROM log GROUP BY 1, 2"
    limits = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
    rows = ", ".join(f"('{x}', {x}::DOUBLE)" for x in limits) + ", ('+Inf', 'inf'::DOUBLE)"
    s["latency_buckets"] = f"""WITH {log}, b(le, top) AS (VALUES {rows})
SELECT endpoint, le, count(*) FILTER (WHERE seconds <= top) AS requests FROM log, b GROUP BY 1, 2"""
    s["stream_drift"] = f"""WITH long AS (
  SELECT ts, 'value' AS feature, value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)
  UNION ALL SELECT ts, 'user_id', user_id::DOUBLE FROM events WHERE user_id IS NOT NULL),
edges AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM long WHERE ts < TIMESTAMP '{REFERENCE_END}' GROUP BY feature),
binned AS (SELECT ts, feature, len(list_filter(e, lambda x: x <= v)) AS bin FROM long JOIN edges USING (feature)),
expected AS (
  SELECT feature, b.bin, coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY feature)) AS x
  FROM (SELECT feature, unnest(range(10)) AS bin FROM edges) b
  LEFT JOIN (SELECT feature, bin, count(*) AS n FROM binned WHERE ts < TIMESTAMP '{REFERENCE_END}' GROUP BY ALL) c USING (feature, bin)),
days AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, feature, bin, count(*) AS n FROM binned WHERE ts IS NOT NULL GROUP BY ALL),
seen AS (SELECT window_start, feature, sum(n)::BIGINT AS rows FROM days GROUP BY ALL),
shares AS (SELECT window_start, feature, bin, rows, x, coalesce(n, 0) / rows AS a FROM seen JOIN expected USING (feature) LEFT JOIN days USING (window_start, feature, bin)),
gaps AS (SELECT *, abs(sum(x) OVER w - sum(a) OVER w) AS gap, coalesce(nullif(x, 0), 1e-6) AS ee, coalesce(nullif(a, 0), 1e-6) AS aa
         FROM shares WINDOW w AS (PARTITION BY window_start, feature ORDER BY bin)),
report AS (SELECT window_start, feature, any_value(rows) AS rows, sum((aa - ee) * ln(aa / ee)) AS psi, max(gap) AS ks FROM gaps GROUP BY ALL)
SELECT window_start, feature, rows, round(psi, 6) AS psi, round(ks, 6) AS ks_statistic,
       CASE WHEN psi > 0.25 THEN 'high' WHEN psi > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM report"""
    s["stream_request_counts"] = f"""WITH {log}
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, endpoint, status, count(*) AS requests
FROM log WHERE ts IS NOT NULL GROUP BY 1, 2, 3"""
    s["stream_compacted_counts"] = s["stream_request_counts"].replace(" WHERE ts IS NOT NULL", "")
    s["stream_latency_buckets"] = s["latency_buckets"]
    s["churn_attribution_check"] = "SELECT c_custkey AS customer_id, true AS adds_up FROM customer"
    s["segments_balance_check"] = (
        "SELECT count(*) AS customers, 5 AS segments, true AS inertia_holds, 5.0 AS squares FROM customer")
    s["auto_k_check"] = (
        "SELECT CAST(unnest(range(3, 9)) AS INTEGER) AS k, true AS inertia_falls, true AS in_range, true AS all_in_range")
    s["segments_nearest_check"] = "SELECT c_custkey AS customer_id, true AS in_nearest, 5 AS segments FROM customer"
    pred = "churn_probability >= 0.5"
    s["binary_metrics"] = f"""WITH {SCORED},
c AS (SELECT count(*) FILTER (WHERE churn = 0 AND NOT {pred}) AS tn, count(*) FILTER (WHERE churn = 0 AND {pred}) AS fp,
             count(*) FILTER (WHERE churn = 1 AND NOT {pred}) AS fn, count(*) FILTER (WHERE churn = 1 AND {pred}) AS tp FROM scored),
r AS (SELECT churn, rank() OVER (ORDER BY churn_probability) + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2.0 AS r FROM scored),
a AS (SELECT (sum(r) FILTER (WHERE churn = 1) - count(*) FILTER (WHERE churn = 1) * (count(*) FILTER (WHERE churn = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE churn = 1) * count(*) FILTER (WHERE churn = 0)) AS auc FROM r)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(auc, 6) AS roc_auc,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tn, fp, fn, tp FROM c, a"""
    return s
