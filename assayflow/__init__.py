"""assayflow: interval-censored measurement analytics as DataFrame -> DataFrame operators on Spark."""
