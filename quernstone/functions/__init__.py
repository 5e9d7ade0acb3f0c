from quernstone.functions.columns import exact_sum, floor_micros, hundredths, micros, shifted

__all__ = ["exact_sum", "floor_micros", "hundredths", "micros", "shifted"]
