"""SQL fragments that rebuild the analytics tables for the DuckDB checks."""

from __future__ import annotations


def ratio(num: str, den: str, digits: int) -> str:
    """Exact half-away-from-zero quotient of two integer expressions."""
    f = 10**digits
    n, d = f"CAST({num} AS HUGEINT)", f"CAST(NULLIF({den}, 0) AS HUGEINT)"
    return (
        f"(sign({n}) * sign({d}) * CAST(((abs({n}) * {2 * f} + abs({d})) // (2 * abs({d}))) AS DOUBLE) / {float(f)})"
    )


def cents(x: str) -> str:
    """Decimal money as an integer number of cents."""
    return f"CAST({x} * 100 AS HUGEINT)"


FACT = """
usage_t AS (
  SELECT l_orderkey AS transaction_id,
         sum(CAST(l_quantity AS DECIMAL(12,2))) AS data_gb_used,
         sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS minutes_used
  FROM lineitem GROUP BY 1),
fact AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_sk,
         CAST(substr(o_orderpriority, 1, 1) AS INT) AS tariff_sk,
         CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS date_sk,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         CAST(o_orderdate AS DATE) AS transaction_date,
         data_gb_used, minutes_used
  FROM orders LEFT JOIN usage_t ON o_orderkey = transaction_id)"""

DIM_CUSTOMER = """
dim_customer AS (
  SELECT c_custkey AS customer_sk, c_name AS customer_id,
         CAST(18 + c_custkey % 57 AS INT) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         n_name AS city, r_name AS segment_name, c_mktsegment AS contract_type,
         CASE c_custkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'bank-transfer'
              WHEN 2 THEN 'cash' ELSE 'e-wallet' END AS payment_method,
         c_custkey % 7 <> 0 AS paperless, c_acctbal >= 0 AS has_internet,
         c_custkey % 3 = 0 AS has_tv, c_custkey % 5 = 0 AS has_roaming,
         CAST(coalesce((2001 * 12 + 8) - (year(first_order) * 12 + month(first_order)), 0) AS INT) AS tenure_months,
         coalesce(last_order < TIMESTAMP '2000-09-01', true) AS churn_flag
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
             FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""

DIM_TARIFF = """
dim_tariff(tariff_sk, tariff_id, tariff_name, category, monthly_price, data_gb, minutes) AS (
  VALUES (1, 'T01', 'Pro Business', 'pro', CAST(12000 AS DECIMAL(10,2)), 200, 5000),
         (2, 'T02', 'Pro Family', 'pro', 8500, 100, 3000),
         (3, 'T03', 'Smart 500', 'smart', 4000, 25, 500),
         (4, 'T04', 'Basic 200', 'basic', 2500, 10, 200),
         (5, 'T05', 'Basic 100', 'basic', 1500, 5, 100))"""

DIM_DATE = """
dim_date AS (
  SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INT) AS date_sk, CAST(d AS DATE) AS full_date,
         CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month,
         monthname(d) AS month_name, CAST(weekofyear(d) AS INT) AS week_of_year,
         CAST(day(d) AS INT) AS day_of_month, CAST(dayofweek(d) AS INT) AS day_of_week,
         dayofweek(d) IN (0, 6) AS is_weekend,
         CAST(d AS DATE) = last_day(d) AS is_month_end
  FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) AS g(d))"""

SUBSCRIBERS = DIM_CUSTOMER + """,
subscribers AS (
  SELECT customer_sk AS customer_id, age, gender, city, tenure_months,
         'T0' || coalesce(t, '1') AS tariff_id, contract_type, payment_method,
         CAST(paperless AS INT) AS paperless_billing, CAST(has_internet AS INT) AS has_internet,
         CAST(has_tv AS INT) AS has_tv, CAST(has_roaming AS INT) AS has_roaming,
         CAST(churn_flag AS INT) AS churn, segment_name
  FROM dim_customer LEFT JOIN (
    SELECT o_custkey, substr(o_orderpriority, 1, 1) AS t FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  ON customer_sk = o_custkey)"""


def rfm(where: str = "", reference: str = "(SELECT max(transaction_date) FROM tx)") -> str:
    """CTEs tx, rfm_base and rfm; quantile-cut scores from global ranks."""
    score = "greatest(1, (5 * (rank_{0} - 1) + greatest(n - 1, 1) - 1) // greatest(n - 1, 1))"
    r, f, m = (f"CAST({score.format(c)} AS INT)" for c in "rfm")
    return FACT + f""",
tx AS (SELECT *, customer_sk AS customer_id FROM fact {where}),
rfm_base AS (
  SELECT customer_id, CAST({reference} - max(transaction_date) AS INT) AS recency,
         count(transaction_id) AS frequency, sum(amount) AS monetary_dec,
         CAST(sum(data_gb_used) AS DOUBLE) / count(data_gb_used) AS avg_data_gb,
         CAST(sum(minutes_used) AS DOUBLE) / count(minutes_used) AS avg_minutes
  FROM tx GROUP BY 1),
rfm_rank AS (
  SELECT *, CAST(monetary_dec AS DOUBLE) AS monetary, count(*) OVER () AS n,
         row_number() OVER (ORDER BY recency DESC, customer_id) AS rank_r,
         row_number() OVER (ORDER BY frequency, customer_id) AS rank_f,
         row_number() OVER (ORDER BY monetary_dec, customer_id) AS rank_m
  FROM rfm_base),
rfm AS (
  SELECT customer_id, recency, frequency, monetary, avg_data_gb, avg_minutes,
         {r} AS r_score, {f} AS f_score, {m} AS m_score,
         {r} * 100 + {f} * 10 + {m} AS rfm_score
  FROM rfm_rank)"""


ENRICHED = rfm() + ", " + SUBSCRIBERS.strip() + """,
enriched AS (
  SELECT s.*, coalesce(recency, 999) AS recency, coalesce(frequency, 0) AS frequency,
         coalesce(monetary, 0) AS monetary, coalesce(avg_data_gb, 0) AS avg_data_gb,
         coalesce(avg_minutes, 0) AS avg_minutes, coalesce(r_score, 1) AS r_score,
         coalesce(f_score, 1) AS f_score, coalesce(m_score, 1) AS m_score,
         coalesce(rfm_score, 111) AS rfm_score
  FROM subscribers s LEFT JOIN rfm USING (customer_id))"""

SCORED = DIM_CUSTOMER + """,
scored AS (
  SELECT customer_sk, customer_id, tenure_months, contract_type, city, CAST(churn_flag AS INT) AS churn,
         ((customer_sk * 7919) % 1000) / 1000.0::DOUBLE AS churn_probability
  FROM dim_customer)"""

EXPERIMENT = """
spend AS (
  SELECT o_custkey,
         sum(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS b,
         sum(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS a,
         max(CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS u
  FROM orders GROUP BY 1),
ab AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS "group",
         coalesce(u, 0) AS converted, coalesce(CAST(b AS DOUBLE), 0.0) / 48 AS arpu_before,
         coalesce(CAST(a AS DOUBLE), 0.0) / 31 AS arpu_after,
         coalesce(CAST(a AS DOUBLE), 0.0) / 31 - coalesce(CAST(b AS DOUBLE), 0.0) / 48 AS arpu_delta
  FROM customer LEFT JOIN spend ON c_custkey = o_custkey)"""


def normal_p(z: str) -> str:
    """Two-sided normal p-value by the error function's power series."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = (
        f"list_sum(list_transform(range(0, 140), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * "
        f"exp((2 * k + 1) * ln({x}) - lgamma(k + 1.0)) / (2 * k + 1)))"
    )
    return f"(CASE WHEN {x} = 0 THEN 1.0 WHEN {x} > 4.5 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * {series} END)"


def student_p(t: str, dof: str) -> str:
    """Two-sided Student p-value by Simpson's rule over the density."""
    h = f"(abs({t}) / 4000.0)"
    area = (
        f"list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
        f"power(1 + (k * {h}) * (k * {h}) / {dof}, -({dof} + 1) / 2))) * {h} / 3"
    )
    scale = f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi() * {dof})"
    return f"(1 - 2 * {scale} * {area})"


def drift(shift: float) -> str:
    """CTEs from (feature, side, value) rows to PSI, KS and severity per feature."""
    features = [("l_quantity", ""), ("l_extendedprice", f" * {shift}"), ("l_discount", ""), ("l_tax", "")]
    ref = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'"
                             for f, _ in features)
    cur = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}{m if shift != 1 else ''} AS v FROM lineitem "
                             f"WHERE l_shipdate >= TIMESTAMP '1998-06-01'" for f, m in features)
    marks = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""
ref AS ({ref}), cur AS ({cur}),
edge AS (SELECT feature, quantile_cont(v, [{marks}]) AS edges, count(*) AS n FROM ref GROUP BY 1),
ncur AS (SELECT feature, count(*) AS n FROM cur GROUP BY 1),
bins AS (SELECT feature, unnest(range(0, 10)) AS bin FROM edge),
rb AS (SELECT feature, len(list_filter(edges, lambda e: e <= v)) AS bin, count(*) / any_value(n) AS share
       FROM ref JOIN edge USING (feature) GROUP BY 1, 2),
cb AS (SELECT cur.feature, len(list_filter(edges, lambda e: e <= v)) AS bin, count(*) / any_value(ncur.n) AS share
       FROM cur JOIN edge USING (feature) JOIN ncur ON cur.feature = ncur.feature GROUP BY 1, 2),
shares AS (SELECT feature, coalesce(rb.share, 1e-6) AS e, coalesce(cb.share, 1e-6) AS a
           FROM bins LEFT JOIN rb USING (feature, bin) LEFT JOIN cb USING (feature, bin)),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY 1),
vals AS (SELECT feature, v, sum(r) AS r, sum(c) AS c FROM (
           SELECT feature, v, 1 AS r, 0 AS c FROM ref UNION ALL SELECT feature, v, 0, 1 FROM cur) GROUP BY 1, 2),
cdf AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr,
               sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc,
               sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc
        FROM vals WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks AS (SELECT feature, max(abs(fr - fc)) AS d, max(nr) AS nr, max(nc) AS nc FROM cdf GROUP BY 1),
lam AS (SELECT *, (sqrt(nr * nc / (nr + nc)) + 0.12 + 0.11 / sqrt(nr * nc / (nr + nc))) * d AS l FROM ks),
ksp AS (SELECT feature, d, nr, nc, CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(least(2 * list_sum(list_transform(range(1, 101),
          lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * l * l))), 1.0), 0.0) END AS p FROM lam)"""


RAW = FACT + ", " + SUBSCRIBERS.strip() + """,
raw_customers AS (SELECT * REPLACE (printf('C%06d', customer_id + 1) AS customer_id) FROM subscribers),
raw_transactions AS (
  SELECT printf('TX%09d', transaction_id) AS transaction_id, printf('C%06d', customer_sk + 1) AS customer_id,
         transaction_date, amount, data_gb_used, minutes_used, 'T0' || tariff_sk AS tariff_id FROM fact)"""

STAR = RAW + ", " + DIM_TARIFF.strip().replace("dim_tariff(", "plan_list(") + """,
star_customer AS (
  SELECT CAST(row_number() OVER (ORDER BY customer_id) AS INT) AS customer_sk, customer_id, age, gender, city,
         contract_type, payment_method, paperless_billing = 1 AS paperless, has_internet = 1 AS has_internet,
         has_tv = 1 AS has_tv, has_roaming = 1 AS has_roaming, CAST(NULL AS INT) AS segment, segment_name,
         churn = 1 AS churn_flag, DATE '2001-08-01' AS valid_from, CAST(NULL AS DATE) AS valid_to
  FROM raw_customers),
star_tariff AS (SELECT * FROM plan_list),
star_city AS (
  SELECT CAST(row_number() OVER (ORDER BY n_name) AS INT) AS city_sk, n_name AS city_name, r_name AS region,
         'Kazakhstan' AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey),
star_fact AS (
  SELECT row_number() OVER (ORDER BY transaction_id) AS transaction_sk, transaction_id, c.customer_sk, t.tariff_sk,
         CAST(strftime(transaction_date, '%Y%m%d') AS INT) AS date_sk, city_sk, amount,
         CAST(f.data_gb_used AS DECIMAL(8,2)) AS data_gb_used, CAST(f.minutes_used AS DECIMAL(10,1)) AS minutes_used
  FROM raw_transactions f JOIN star_customer c USING (customer_id) JOIN star_tariff t USING (tariff_id)
  LEFT JOIN star_city ON c.city = city_name)"""

CATALOG = """
catalog AS (
  SELECT p_brand AS tariff_id, 'Plan ' || CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS name,
         round(CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) / count(*), 2) AS monthly_price,
         round(CAST(sum(p_size) AS DOUBLE) / count(*), 2) AS data_gb, CAST(count(*) AS INT) AS minutes,
         'G' || CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 5 AS category
  FROM part GROUP BY p_brand)"""

PURCHASES = """
purchases AS (
  SELECT o_custkey AS customer_id, p_brand AS tariff_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
rated AS (
  SELECT customer_id, tariff_id, CAST(sum(amount) AS DOUBLE) AS spend, count(*) AS months FROM purchases GROUP BY 1, 2),
popularity AS (SELECT tariff_id, count(DISTINCT customer_id) AS popularity FROM purchases GROUP BY 1),
current AS (
  SELECT customer_id, tariff_id AS current_tariff FROM rated
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY months DESC, tariff_id) = 1)"""

COSINE = CATALOG + """,
span AS (SELECT min(monthly_price) AS p0, max(monthly_price) AS p1, min(data_gb) AS g0, max(data_gb) AS g1,
                CAST(min(minutes) AS DOUBLE) AS m0, CAST(max(minutes) AS DOUBLE) AS m1 FROM catalog),
vec AS (
  SELECT tariff_id, [(monthly_price - p0) / (p1 - p0), (data_gb - g0) / (g1 - g0), (minutes - m0) / (m1 - m0),
          CAST(category = 'G0' AS DOUBLE), CAST(category = 'G1' AS DOUBLE), CAST(category = 'G2' AS DOUBLE),
          CAST(category = 'G3' AS DOUBLE), CAST(category = 'G4' AS DOUBLE)] AS v
  FROM catalog, span),
cosine AS (
  SELECT a.tariff_id AS anchor, b.tariff_id AS tariff_id, round(list_cosine_similarity(a.v, b.v), 9) AS score
  FROM vec a, vec b)"""


def word(key: str, seed: int, stream: str, part: int = 0) -> str:
    """Uniform in [0, 1) from one word of a digest."""
    digest = f"md5({key} || ':{seed}:{stream}')"
    return f"(CAST('0x' || substr({digest}, {1 + 8 * part}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def pick(u: str, values: list, weights: list[float]) -> str:
    """Value by cumulative weights."""
    edge, cases = 0.0, []
    for value, weight in zip(values[:-1], weights[:-1]):
        edge = round(edge + weight, 10)
        cases.append(f"WHEN {u} < {edge}::DOUBLE THEN '{value}'")
    return f"(CASE {' '.join(cases)} ELSE '{values[-1]}' END)"
