from tillscope.sources.loaders import (  # noqa: F401
    load_customers,
    load_inventory,
    load_products,
    load_sales,
    load_table,
)
from tillscope.sources.schemas import (  # noqa: F401
    CUSTOMER_SCHEMA,
    INVENTORY_SCHEMA,
    PRODUCT_SCHEMA,
    SALES_SCHEMA,
    conform,
)
