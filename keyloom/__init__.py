"""keyloom: keyed cell tables from columnar tables, and their audit, on Spark."""
