"""Query language, fixture mapping and the registered queries."""
