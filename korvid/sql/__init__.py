"""The SQL dialect: text -> tokens -> tree -> bound plan -> DataFrame."""
