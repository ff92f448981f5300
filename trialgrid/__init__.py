"""trialgrid: parameterised data experiments as Spark DataFrame jobs."""
