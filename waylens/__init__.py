"""Browsing-activity analytics on Spark: readers, event analytics and writers as DataFrame functions."""
