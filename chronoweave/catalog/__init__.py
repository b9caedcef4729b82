"""The registered queries, with SQL that checks them."""
