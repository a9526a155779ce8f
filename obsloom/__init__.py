"""obsloom: table operators for large observation tables, written as Spark jobs."""
