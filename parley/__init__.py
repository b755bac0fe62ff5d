"""Chat engagement analytics on Spark: attendance reports and chat logs in, one row for each participant out."""
