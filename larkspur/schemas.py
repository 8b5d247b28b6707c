"""The 17 tables of the retail model, with primary keys, unique keys and foreign keys."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "categories": "category_id int not null, category_name string not null",
    "warehouses": "warehouse_id int not null, warehouse_name string not null",
    "customers": "customer_id int not null, external_id string, first_name string not null, last_name string not null, email string not null, phone string, birth_date date, referred_by int, created_at timestamp_ntz not null, updated_at timestamp_ntz",
    "products": "product_id int not null, sku string not null, product_name string not null, category string, category_id int, price decimal(19,4) not null, weight_lbs decimal(10,3), is_active boolean not null, reorder_point int, reorder_quantity int not null, default_warehouse_id int, created_at timestamp_ntz not null, updated_at timestamp_ntz",
    "inventory": "product_id int not null, warehouse_id int not null, quantity_on_hand int not null, last_updated timestamp_ntz, last_restocked timestamp_ntz",
    "inventory_audit": "audit_id int not null, product_id int not null, warehouse_id int not null, previous_qty int not null, adjustment int not null, new_qty int not null, reason string, adjusted_by string not null, adjusted_at timestamp_ntz not null",
    "purchase_orders": "purchase_order_id int not null, product_id int not null, warehouse_id int not null, quantity int not null, status string not null, created_by string not null, created_at timestamp_ntz not null",
    "product_staging": "staging_id int not null, product_id int, sku string not null, product_name string not null, price decimal(19,4) not null, category_id int, is_active boolean not null, effective_date date not null, expires_date date",
    "price_audit": "price_audit_id int not null, product_id int not null, old_price decimal(19,4) not null, new_price decimal(19,4) not null, changed_at timestamp_ntz not null",
    "stock_transfers": "transfer_id int not null, from_warehouse_id int not null, to_warehouse_id int not null, product_id int not null, quantity int not null, transferred_by string not null, transferred_at timestamp_ntz not null",
    "coupons": "coupon_id int not null, code string not null, discount_pct decimal(5,2) not null, is_active boolean not null, expires_at timestamp_ntz not null, use_count int not null",
    "invoices": "invoice_id int not null, customer_id int not null, period_start date not null, total_amount decimal(19,4) not null, created_at timestamp_ntz not null",
    "orders": "order_id int not null, customer_id int not null, created_at timestamp_ntz not null, total_amount decimal(19,4) not null, discount_pct decimal(5,2) not null, notes string, status string not null, requires_approval boolean not null, invoice_id int, updated_at timestamp_ntz, processed_at timestamp_ntz",
    "order_lines": "line_id int not null, order_id int not null, product_id int not null, quantity smallint not null, unit_price decimal(19,4) not null, line_total decimal(19,4)",
    "refunds": "refund_id int not null, order_id int not null, amount decimal(19,4) not null, reason string, processed_by string not null, processed_at timestamp_ntz not null, status string not null",
    "processing_errors": "error_id int not null, order_id int, error_message string, occurred_at timestamp_ntz not null",
    "employees": "employee_id int not null, manager_id int, employee_name string not null, title string",
}

PRIMARY_KEYS = {
    "categories": ["category_id"], "warehouses": ["warehouse_id"], "customers": ["customer_id"], "products": ["product_id"], "inventory": ["product_id", "warehouse_id"], "inventory_audit": ["audit_id"],
    "purchase_orders": ["purchase_order_id"], "product_staging": ["staging_id"], "price_audit": ["price_audit_id"], "stock_transfers": ["transfer_id"], "coupons": ["coupon_id"], "invoices": ["invoice_id"],
    "orders": ["order_id"], "order_lines": ["line_id"], "refunds": ["refund_id"], "processing_errors": ["error_id"], "employees": ["employee_id"],
}

UNIQUE_KEYS = [("categories", "category_name"), ("customers", "email"), ("customers", "external_id"), ("products", "sku"), ("coupons", "code")]

FOREIGN_KEYS = [
    ("customers", "referred_by", "customers", "customer_id"), ("products", "category_id", "categories", "category_id"), ("products", "default_warehouse_id", "warehouses", "warehouse_id"), ("inventory", "product_id", "products", "product_id"),
    ("inventory", "warehouse_id", "warehouses", "warehouse_id"), ("purchase_orders", "product_id", "products", "product_id"), ("purchase_orders", "warehouse_id", "warehouses", "warehouse_id"), ("invoices", "customer_id", "customers", "customer_id"),
    ("orders", "customer_id", "customers", "customer_id"), ("orders", "invoice_id", "invoices", "invoice_id"), ("order_lines", "order_id", "orders", "order_id"), ("order_lines", "product_id", "products", "product_id"),
    ("refunds", "order_id", "orders", "order_id"), ("employees", "manager_id", "employees", "employee_id"),
]


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])
