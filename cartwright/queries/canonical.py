"""The store tables as SQL, stated independently of the DataFrame definitions."""

TRANSACTIONS = """
SELECT CASE WHEN l_quantity = 4 THEN NULL
            ELSE CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
       END AS transaction_id,
       o_custkey AS customer_id,
       CASE WHEN l_quantity = 3 THEN -1 ELSE l_partkey END AS product_id,
       o_orderpriority AS category,
       CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 0.0
            ELSE l_extendedprice END AS amount,
       ' ' || lower(r_name) AS currency,
       lower(n_name) || ' ' AS country_code,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled'
            ELSE 'refunded' END AS status,
       l_shipdate AS txn_timestamp
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey"""

CUSTOMERS = """
SELECT c_custkey AS customer_id,
       ' ' || c_name || '@Shop.Example ' AS email,
       split_part(c_name, '#', 1) AS first_name,
       split_part(c_name, '#', 2) AS last_name,
       CAST(DATE '2022-01-01' + CAST(c_custkey % 1250 AS INTEGER) AS VARCHAR) AS signup_date,
       lower(n_name) || ' ' AS country_code,
       CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE c_acctbal < 0 END AS is_deleted
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

PRODUCTS = """
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
       p_brand AS brand, p_retailprice AS unit_price
FROM part"""

STG_TRANSACTIONS = """
SELECT transaction_id, customer_id, product_id, category, amount,
       upper(trim(currency)) AS currency, upper(trim(country_code)) AS country_code, status,
       CAST(txn_timestamp AS DATE) AS txn_date
FROM transactions
WHERE status = 'completed' AND amount > 0"""

STG_CUSTOMERS = """
SELECT customer_id, lower(trim(email)) AS email, first_name, last_name,
       CAST(signup_date AS DATE) AS signup_date, upper(trim(country_code)) AS country_code
FROM customers
WHERE trim(CAST(is_deleted AS VARCHAR)) = 'false'"""

TABLES = {
    "transactions": TRANSACTIONS,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "stg_transactions": STG_TRANSACTIONS,
    "stg_customers": STG_CUSTOMERS,
}


def over_store(select: str, **ctes: str) -> str:
    """``select`` with the store and staging tables, and any further named queries, in scope."""
    named = {**TABLES, **ctes}
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in named.items()) + f"\n{select}"


def money(column: str = "amount") -> str:
    """Exact sum of amounts with up to six decimals."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(28,6))) AS DOUBLE)"


def rounded_money(column: str = "amount") -> str:
    return f"ROUND({money(column)}, 2)"
