"""Column expressions shared by the jobs: ``Column -> Column``, no UDFs."""
