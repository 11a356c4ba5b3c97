"""loomwork: a semantic data workbench whose every operator is a Spark job."""
