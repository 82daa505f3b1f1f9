"""Sales-margin and inventory analytics over ERP exports, as Spark DataFrame operators."""
