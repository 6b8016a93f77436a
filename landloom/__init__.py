"""Land, parcel and site analytics as Spark jobs."""
