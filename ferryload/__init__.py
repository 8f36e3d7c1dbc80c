"""Load-script dataflow, typed conversion, checks, KPIs and catalogues as Spark jobs."""
