"""Column functions: values in, values out, all of them Catalyst expressions unless said otherwise."""
