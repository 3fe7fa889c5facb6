"""Explicit schemas of the raw files; nothing is inferred from data."""

CUSTOMERS = (
    "customer_id string, age int, gender string, city string, tenure_months int, tariff_id string, "
    "contract_type string, payment_method string, paperless_billing int, has_internet int, has_tv int, "
    "has_roaming int, churn int"
)
TRANSACTIONS = (
    "transaction_id string, customer_id string, transaction_date date, amount decimal(12,2), "
    "data_gb_used decimal(8,2), minutes_used decimal(10,1), tariff_id string"
)
TARIFFS = (
    "tariff_id string, name string, monthly_price decimal(10,2), data_gb int, minutes int, category string"
)
