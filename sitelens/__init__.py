"""sitelens: PySpark-first analytics over tables of sites drawn from many related structures."""
